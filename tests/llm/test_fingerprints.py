from __future__ import annotations

import hashlib
import math
import struct
from collections import Counter

import numpy as np
import pytest
from brevia.llm import fingerprints as S
from brevia.llm.textkit import hash_of, mix
from pyspark.sql import functions as F


def jaccard(a, b):
    a, b = (Counter(x.encode().lower().split()) for x in (a, b))
    words = {*a, *b}
    return sum(min(a[w], b[w]) for w in words) / sum(max(a[w], b[w]) for w in words) if words else 1.0


def test_collision_rate_is_generalised_jaccard():
    draw = np.random.default_rng(2)
    errors = []
    for _ in range(150):
        n = int(draw.integers(1, 60))
        a, b = (" ".join(f"w{k}" for k in range(n) for _ in range(int(draw.integers(0, 6)))) or "w" for _ in range(2))
        x, y = S.signatures([a.encode(), b.encode()])
        errors.append(S.likeness(x[None], y[None])[0] - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 1.3 * 0.5 / S.SAMPLES**0.5


def plain_signature(text):
    """The sampler word by word, in plain numbers."""
    salts = [int(x) | 1 for x in mix(np.arange(1, S.SAMPLES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))]
    gamma, log_gamma = S._quantiles(16), np.log(S._quantiles(20))
    one, out = np.float32, []
    for salt in salts:
        least = None
        for word, weight in Counter(text.encode().lower().split()).items():
            x = hash_of(word.decode()) * salt % 2**64
            x = (x ^ x >> 32) * 0x94D049BB133111EB % 2**64
            x ^= x >> 32
            r, b, c = one(gamma[x >> 48]), one((x >> 32 & 0xFFFF) / 2**16), one(log_gamma[(x & 0xFFFFFFFF) >> 12])
            t = one(math.floor(one(math.log(weight)) / r + b))
            value = c + r * (b - one(1)) - r * t
            least = value if least is None else min(least, value)
        if least is None:
            out.append(0)
            continue
        (bits,) = struct.unpack("<I", struct.pack("<f", least))
        bits = ~bits & 0xFFFFFFFF if bits >> 31 else bits | 1 << 31
        out.append(max(1, bits * 0x9E3779B1 % 2**32 >> 16))
    return out


def test_signatures_equal_the_plain_sampler():
    draw = np.random.default_rng(5)
    texts = ["", " \n", "a", "a a a a b", "Ünder A b B b"] + [" ".join(f"w{int(k)}" for k in draw.zipf(1.3, 200) % 500) for _ in range(3)]
    found = S.signatures([t.encode() for t in texts])
    assert [x.tolist() for x in found] == [plain_signature(t) for t in texts]


def test_quantiles_are_those_of_the_gamma_distribution():
    for bits in (10, 16):
        x = S._quantiles(bits)
        assert np.abs(1 - np.exp(-x) * (1 + x) - (np.arange(1 << bits) + 0.5) / (1 << bits)).max() < 1e-6


def test_signatures_do_not_depend_on_company(monkeypatch):
    texts = ["a b c", "", "A  b\nC", "long " * 300 + " ".join(map(str, range(3000)))]
    whole = S.signatures([t.encode() for t in texts])
    assert (whole[0] == whole[2]).all() and not whole[1].any() and (whole[[0, 2, 3]] > 0).all()
    monkeypatch.setattr(S, "PAIRS", 100)
    assert all((S.signatures([t.encode()])[0] == w).all() for t, w in zip(texts, whole, strict=True))


def check(rows, found):
    """rows: (doc_id, text) in order; found by doc_id."""
    texts = [t or "" for _, t in rows]
    for k, (key, _) in enumerate(rows):
        text, after, have = texts[k], texts[(k + 1) % len(rows)], found[key]
        third = len(text) // 3
        want = text[: len(text) - third] + after[:third]
        assert have.n_chars == len(text) and have.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        prints = S.signatures([x.encode() for x in (text, want, after)])
        assert [have.fingerprint, have.edited_fingerprint] == S.as_hex(prints[:2])
        assert [have.near_edited, have.near_next] == S.likeness(prints[[0, 0]], prints[1:]).tolist()


@pytest.mark.parametrize(("n", "block"), [("1", 1 << 20), ("7", 2000)])
def test_every_row_meets_its_successor(spark, sf_dir, monkeypatch, n, block):
    monkeypatch.setattr(S, "BLOCK", block)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
        rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
        found = S.fingerprint_edits(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(found) == len(rows)
    check(rows, {r.doc_id: r for r in found})
    assert np.mean([r.near_edited > r.near_next for r in found]) > 0.95


def test_hot_and_null_keys(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        rows = [(5, f"hot {k}") for k in range(300)] + [(None, f"none {k}") for k in range(300)] + [(k, f"own {k}") for k in range(-100, 100) if k != 5]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        dealt = S.with_next(docs).filter("copied = 0").groupBy("bucket").count().collect()
        found = S.fingerprint_edits(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert max(r["count"] for r in dealt) < 150
    order = [r.text for r in docs.orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text").collect()]
    want = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(order, order[1:] + order[:1], strict=True)]
    assert sorted(r.edited_sha256 for r in found) == sorted(hashlib.sha256(x.encode()).hexdigest() for x in want)


def test_odd_tables(spark):
    schema = "doc_id long, text string, bucket int, copied int, key string, near_next int"
    docs = spark.createDataFrame([(9, "a b c d e f", 1, 1, "k", 1), (4, None, 1, 1, "k", 1), (None, "é" * 50_000, 0, 0, "", 0), (2, "x", 0, 0, "", 0)], schema)
    found = S.fingerprint_edits(docs).collect()
    check([(9, "a b c d e f"), (4, None), (2, "x"), (None, "é" * 50_000)], {r.doc_id: r for r in found})
    same = spark.createDataFrame([(1, "a b")] * 5, "doc_id long, text string")
    assert [r.near_next for r in S.fingerprint_edits(same).collect()] == [1.0] * 5
    assert S.fingerprint_edits(docs.limit(1)).count() == 1 and S.fingerprint_edits(docs.filter(F.lit(False))).count() == 0
