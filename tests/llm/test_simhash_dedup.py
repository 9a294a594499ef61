from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from brevia.llm import shared
from brevia.llm import simhash_dedup as S
from brevia.llm.components import components
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(near):
    """By row: the smallest row reachable over a matrix of links, or over fingerprints at 4 or fewer differing bits."""
    if np.ndim(near) == 1:
        p = np.array(near, np.uint64)
        near = np.bitwise_count(p[:, None] ^ p[None, :]) <= 4
    label = np.arange(len(near))
    while True:
        new = np.where(near, label[None, :], len(near)).min(1)
        if (new == label).all():
            return label
        label = new


def planted(n, seed=0):
    draw = np.random.default_rng(seed)
    base = draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    chain = base[: n // 4].copy()
    for k in range(len(chain)):
        for b in draw.choice(64, draw.integers(0, 7), replace=False):
            chain[k] ^= np.uint64(1 << int(b))
    tight = np.full(n // 4, base[-1])
    for k in range(len(tight)):
        tight[k] ^= np.uint64(1 << int(draw.integers(64)))
    return np.unique(np.concatenate([base, chain, tight]))


def test_fingerprints_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in S.op8_simhash_dedup(spark, sf_dir).collect():
        assert r.fingerprint == f"{brute_print(texts[r.doc_id]):016x}"
    edges = [None, "", " \n", "a", "A b", "a b c d", "É \x1c b c d e", "x " * 30_000]
    assert S.column_fingerprints(pa.array(edges).cast(pa.binary()), most=1000).tolist() == [brute_print(x) for x in edges]


def test_jvm_hash_agrees(spark):
    row = spark.sql("select xxhash64('the end of it') h").first()
    assert np.uint64(row.h & (1 << 64) - 1) == S.shingle_hashes(b"The end of it")[0]


@pytest.mark.parametrize("sizes", [(1, 1), (63, 130), (300, 700)])
def test_close_pairs_equal_brute_force(sizes):
    values = planted(2000, 5)
    left, right = values[: sizes[0]], np.concatenate([values[: sizes[1]], values[-50:]])
    for a, b, same in ((left, right, False), (right, right, True)):
        found = {(int(q), int(c)) for x in S.close_pairs(a[:, None], b[:, None], same=same) for q, c in zip(*x, strict=True)}
        distance = np.bitwise_count(a[:, None] ^ b[None, :])
        want = {(int(q), int(c)) for q, c in zip(*np.nonzero(distance <= 4), strict=True) if not same or q < c}
        assert found == want


@pytest.mark.parametrize(("bucket", "tile"), [(1024, 4096), (16, 40), (1, 8)])
def test_components_of_planted_links(spark, monkeypatch, bucket, tile):
    monkeypatch.setattr(S, "BUCKET", bucket)
    monkeypatch.setattr(S, "TILE", tile)
    prints = planted(400, bucket).astype(np.int64)
    frame = spark.createDataFrame([(int(x),) for x in prints], "fp long")
    roots = {r.node: r.root for r in components(S.links(frame, len(prints))).collect()}
    want = brute_components(prints.view(np.uint64))
    have = [roots.get(int(x), int(x)) for x in prints]
    groups = {}
    for x, w in zip(have, want.tolist(), strict=True):
        assert groups.setdefault(w, x) == x
    assert len(set(have)) == len(set(want.tolist()))


@pytest.mark.parametrize(("k", "radius"), [(1, 0), (1, 7), (2, 9), (4, 44), (4, 100)])
def test_wide_pairs_equal_brute_force(k, radius):
    draw = np.random.default_rng(radius)
    a = draw.integers(0, 1 << 63, (150, k), dtype=np.uint64)
    b = np.concatenate([a[:60].copy(), draw.integers(0, 1 << 63, (90, k), dtype=np.uint64)])
    for row in b[:60]:
        for bit in draw.choice(64 * k, draw.integers(0, 2 * radius + 2) % (64 * k), replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    found = {(int(q), int(c)) for x in S.close_pairs(a, b, radius) for q, c in zip(*x, strict=True)}
    distance = np.bitwise_count(a[:, None] ^ b[None, :]).sum(2)
    assert found == {(int(q), int(c)) for q, c in zip(*np.nonzero(distance <= radius), strict=True)}


def similarity(a, b):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("bucket", [2048, 30])
def test_near_copies_are_found(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "RUN_ROWS", bucket)
    draw = np.random.default_rng(bucket)
    vocabulary = np.array([f"w{k}" for k in range(3000)])
    texts, pairs = [], []
    for _ in range(250):
        words = draw.choice(vocabulary, draw.integers(60, 400))
        copy = words.copy()
        copy[draw.choice(len(words), draw.integers(0, max(1, len(words) // 50) + 1), replace=False)] = "changed"
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(words), " ".join(copy)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in S.label(docs, near=True).collect()}
    alike = [similarity(texts[a], texts[b]) for a, b in pairs]
    caught = [found[a] == found[b] for a, b in pairs]
    assert len(set(found.values())) >= 250 and np.mean([c for c, s in zip(caught, alike, strict=True) if s >= 0.8]) > 0.9
    assert np.mean([c for c, s in zip(caught, alike, strict=True) if s >= 0.87]) > 0.98
    kept = {r.doc_id for r in S.filter_documents(docs).collect()}
    assert kept == set(found.values())


def test_frequent_keys_are_joined_apart(spark, monkeypatch):
    from brevia.llm import components as C, shared

    for module in (shared, C):
        monkeypatch.setattr(module, "HOT_ROWS", 20)
    rows = [(k, " ".join(f"{c}{i}" for i in range(30))) for k, c in enumerate(["hot"] * 90 + ["a", "b", "b", "c"])] + [(k, None) for k in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in S.label(docs).collect()}
    assert found == {k: 0 for k in range(90)} | {90: 90, 91: 91, 92: 91, 93: 93} | {k: 100 for k in range(100, 140)}
    star = spark.createDataFrame([(7, k) for k in range(1000, 1100)] + [(1050, 3), (5000, 5001)], "u long, v long")
    assert {r.node: r.root for r in components(star).collect()} == {k: 3 for k in [7, *range(1000, 1100)]} | {5001: 5000}


def test_masks_lose_no_link():
    for n in (10, 10**6, 10**9, 10**12):
        masks = S._masks(n)
        draw = np.random.default_rng(1)
        for _ in range(300):
            flip = sum(1 << int(b) for b in draw.choice(64, 4, replace=False))
            assert any(not flip & x for x in masks)


def test_components_of_chains(spark):
    rows = [(i, i + 1) for i in range(300)] + [(1000, 2000), (2000, 1500), (5, 5), (0, 1)]
    found = {r.node: r.root for r in components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 301)} | {2000: 1000, 1500: 1000}


def test_label_equals_brute_force(spark, sf_dir):
    rows = S.op8_simhash_dedup(spark, sf_dir).orderBy("doc_id").collect()
    want = brute_components([int(r.fingerprint, 16) for r in rows])
    assert [r.component_id for r in rows] == [rows[k].doc_id for k in want]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(r.doc_id for r in S.filter_documents(docs, near=False).collect()) == sorted({r.component_id for r in rows})


def test_odd_tables(spark):
    schema = "doc_id long, text string, fp string, component_id int, root int"
    rows = [(3, "a b c d e", "x", 1, 1), (2, None, None, None, None), (5, "", "", 0, 0), (2, None, None, None, None), (7, "A b C d e", "", 0, 0), (None, "other words in here now", None, 0, 0)]
    docs = spark.createDataFrame(rows, schema)
    found = {r.doc_id: r.component_id for r in S.label(docs).collect()}
    assert found == {3: 3, 2: 2, 5: 2, 7: 3, None: None}
    kept = S.filter_documents(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "None"]
    assert S.label(docs.filter(F.lit(False))).count() == 0 and S.filter_documents(docs.filter(F.lit(False))).count() == 0


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_table(n, seed):
    """Texts with a copy each, whose similarities lie on both sides of 0.8, and a tight group."""
    draw = np.random.default_rng(seed)
    texts = []
    for k in range(n):
        words = draw.choice(2000, draw.integers(40, 200)).astype(str)
        for share in (0, draw.uniform(0, 0.06)):
            copy = words.copy()
            copy[draw.choice(len(words), round(share * len(words)), replace=False)] = f"c{k}"
            texts.append(" ".join(["a passage that many of them share in just these words", *copy] if k % 3 else copy))
    group = draw.choice(2000, 120).astype(str)
    for _ in range(n // 3):
        copy = group.copy()
        edits = draw.integers(1, 4)
        copy[draw.choice(120, edits, replace=False)] = draw.integers(10**4, 10**5, edits).astype(str)
        texts.append(" ".join(copy))
    return [*texts, "", None, "two words", "Two  words"]


def check_near(spark, texts):
    """The stage's components are those of brute force: 0.8 or more of the shingles, or 4 or fewer of 64 bits."""
    sets = [shingles(t) for t in texts]
    alike = np.array([[bool(a) and 5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    prints = np.array([brute_print(t) for t in texts], np.uint64)
    want = brute_components(alike | (np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in S.label(docs, near=True).collect()} == dict(enumerate(want.tolist()))
    assert sorted(r.doc_id for r in S.filter_documents(docs).collect()) == sorted(set(want.tolist()))
    return alike


def test_near_copies_equal_brute_force(spark):
    texts = near_table(120, 3)
    alike = check_near(spark, texts)
    sims = np.array([similarity(texts[k], texts[k + 1]) for k in range(0, 240, 2)])
    assert ((sims >= 0.8) & (sims < 0.85)).sum() > 5 and ((sims > 0.7) & (sims < 0.8)).sum() > 5 and 40 < alike[240:280, 240:280].sum() < 1600


@pytest.mark.parametrize(("bucket", "dense", "group"), [(30, 16, 512), (2048, 1, 7), (2, 16, 7)])
def test_near_copies_of_any_table_size(spark, monkeypatch, bucket, dense, group):
    """What large tables meet: long runs of a shingle, dense ones, groups of several tiles, frequent shingles."""
    for name, value in (("RUN_ROWS", bucket), ("DENSE", dense), ("GROUP", group), ("MOST_FREQUENT", 50)):
        monkeypatch.setattr(S, name, value)
    check_near(spark, near_table(90, bucket + dense))


def test_parities_never_exceed_what_sets_lack():
    draw = np.random.default_rng(2)
    for n in (1, 31, 32, 33, 300, 5000):
        a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 9], draw.integers(0, 1 << 63, n // 4, dtype=np.uint64)]))
        p, q = sorted((S.parity(a).view(np.uint64), S.parity(b).view(np.uint64)), key=len)
        if len(q) > len(p):
            q = q[: len(p)] ^ q[len(p) :]
        assert np.bitwise_count(p ^ q).sum() <= len(np.setxor1d(a, b))


def test_one_row_of_each_component_whatever_the_keys(spark):
    words = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcdef"]
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (3, words[2]), (3, words[3]), (5, words[2]), (3, words[4]), (3, words[4]), (None, words[4])]
    docs = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(rows)], "doc_id long, text string, extra int")
    for near in (False, True):
        kept = S.filter_documents(docs, near=near)
        assert kept.columns == docs.columns
        want = [(None, words[0]), (None, words[1]), (3, words[2]), (3, words[3]), (3, words[4])]
        assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted((str(k), t) for k, t in want)


def shuffle_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(k).getPath() for k in range(found.length()) if found.apply(k).getName().startswith("shuffle_")}


def test_disk_is_given_back_without_the_garbage_collector(spark):
    rows = spark.range(20_000).select((F.col("id") % 9973).alias("k")).repartition(4, "k")
    before = shuffle_files(spark)
    table, path = shared.kept(rows, "test")
    copies = [shared.cut(rows), shared.cut(rows, True), table]  # rows lives on, so nothing is garbage
    assert not shuffle_files(spark) - before
    assert [x.count() for x in copies] == [20_000] * 3
    shared.remove(spark, path)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_only_texts_with_candidates_are_dealt_out(spark):
    keys = spark.createDataFrame([(k * 7919 - 10**9,) for k in range(5000)], "k long")
    wanted = keys.filter("pmod(k, 50) = 3 OR k < -999990000").withColumnRenamed("k", "w")
    got = {r.k for r in shared.probable(keys, "k", wanted).collect()}
    need = {r.w for r in wanted.collect()}
    assert need <= got and len(need) > 50 and len(got) < len(need) + 20
    assert not shared.probable(keys, "k", wanted.limit(0)).count()
    edges = spark.createDataFrame([(x,) for x in (0, -1, shared.MAP_BITS - 1, shared.MAP_BITS, -(1 << 63), (1 << 63) - 1)], "k long")
    assert shared.probable(edges, "k", edges).count() == 6
