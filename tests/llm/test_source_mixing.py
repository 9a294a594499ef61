from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest
from brevia.llm import source_mixing as M
from pyspark.sql import functions as F


def share_out(budget, children):
    """children: name -> (weight, capacity); fills the tightest child again and again."""
    left, out = dict(children), {}
    while left:
        weight = sum(w for w, _ in left.values())
        tight = [n for n, (w, c) in left.items() if not w or c * weight <= w * budget]
        if not tight:
            break
        name = min(tight, key=lambda n: (Fraction(left[n][1], left[n][0]) if left[n][0] else 0, n))
        out[name] = left[name][1]
        budget -= out[name]
        del left[name]
    if left:
        weight = sum(w for w, _ in left.values())
        parts = {n: budget * w // weight for n, (w, _) in left.items()}
        spare = budget - sum(parts.values())
        for name in sorted(left, key=lambda n: (left[n][1] / left[n][0], n))[:spare]:
            parts[name] += 1
        out |= parts
    return out


@pytest.mark.parametrize("seed", range(3))
def test_budgets_equal_brute_force(spark, seed):
    draw = random.Random(seed)
    mix = M.Mix(share=[0.5, 1.0, 2.5][seed], max_epochs=2, source_weights={f"s{k}": draw.randint(0, 9) for k in range(9)})
    supply = {(d, g, f"s{k}"): draw.choice([0, 1, 7, 300, 10_000]) for d in ("web", "books", "other") for g in ("en", "de", "xx") for k in range(draw.randint(1, 9))}
    rows = [(*k, n) for k, n in supply.items()]
    found = {(r.domain, r.lang, r.source): r.budget for r in M.budgets(spark.createDataFrame(rows, "domain string, lang string, source string, tokens long"), mix).collect()}
    weight = lambda level, name: getattr(mix, f"{level}_weights").get(name, mix.other[level])
    capacity = {k: n * 2 * (weight("source", k[2]) > 0) for k, n in supply.items()}

    def down(prefix, budget, want):
        level = M.LEAF[len(prefix)]
        names = sorted({k[len(prefix)] for k in supply if k[: len(prefix)] == prefix})
        children = {n: (weight(level, n), sum(c for k, c in capacity.items() if k[: len(prefix) + 1] == (*prefix, n))) for n in names}
        for name, part in share_out(budget, children).items():
            if len(prefix) == 2:
                want[(*prefix, name)] = part
            else:
                down((*prefix, name), part, want)
        return want

    total = min(int(sum(supply.values()) * mix.share), sum(capacity.values()))
    assert found == down((), total, {})
    assert sum(found.values()) == total and all(found[k] <= capacity[k] for k in found)


def test_query_equals_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(M.oracle()).df()
    names = list(want.columns)
    assert sorted(map(tuple, M.op1_source_mixing(spark, sf_dir).select(names).collect())) == sorted(want.itertuples(index=False, name=None))


def test_epochs_and_prefix(spark, sf_dir):
    mix = M.Mix(share=1.0)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = M.select(docs, mix).collect()
    budget = {(r.domain, r.lang, r.source): r for r in M.budgets(M.measure(docs, mix).groupBy(*M.LEAF).agg(F.sum("n_tokens").alias("tokens")), mix).collect()}
    leaf = defaultdict(list)
    for r in rows:
        leaf[r.domain, r.lang, r.source].append(r)
    for name, drawn in leaf.items():
        whole, rest = divmod(budget[name].budget, budget[name].tokens)
        assert sum(r.take_tokens for r in drawn) == budget[name].budget and max(r.epoch for r in drawn) in (whole, whole - 1)
        last = sorted((r for r in drawn if r.epoch == whole), key=lambda r: hashlib.md5(f"42:{whole}:{r.doc_id}".encode()).hexdigest())
        assert [r.take_tokens for r in last[:-1]] == [r.n_tokens for r in last[:-1]] and sum(r.take_tokens for r in last) == rest


def test_texts_are_cut_to_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"domain": F.lit(1), "epoch": F.lit("x"), "key": F.lit(2), "n_tokens": F.lit(3)})
    out = M.mix_documents(docs, M.Mix())
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    have = sorted((r.doc_id, len(re.findall(M.WORD, r.text))) for r in out.collect() if texts[r.doc_id].startswith(r.text))
    assert have == sorted((r.doc_id, r.take_tokens) for r in M.select(docs, M.Mix()).collect())


def test_odd_tables(spark, monkeypatch):
    schema = "doc_id long, text string, lang string, source string, budget int, weight int"
    rows = [(1, "a b c", "en", "src1", 0, 0)] * 4 + [(None, "x y", None, None, None, None), (2, None, "en", "src1", 0, 0), (3, "", "zz", "", 0, 0), (4, "p " * 5000, "de", "src11", 0, 0)]
    docs = spark.createDataFrame(rows, schema)
    for bound in (M.MAX_LEAVES, 0):
        monkeypatch.setattr(M, "MAX_LEAVES", bound)
        found = M.select(docs, M.Mix(share=1.0)).collect()
        assert 0 < sum(r.take_tokens for r in found) <= 5014 and all(r.take_tokens <= r.n_tokens for r in found)
        assert M.mix_documents(docs, M.Mix(share=1.0)).count() == len(found)
    empty = docs.filter(F.lit(False))
    assert M.select(empty, M.Mix()).count() == 0 and M.mix_documents(empty, M.Mix()).count() == 0


def test_rows_that_share_a_key_fill_the_budget(spark):
    rows = [(None, " ".join(["w"] * (k % 7 + 1) + [f"x{k}"]), "en", "src1") for k in range(200)] + [(5, f"a b c d {k}", "en", "src1") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = M.select(docs, M.Mix(share=0.37)).collect()
    total = sum(len(r[1].split()) for r in rows)
    assert sum(r.take_tokens for r in found) == int(total * 0.37) and sum(r.take_tokens < r.n_tokens for r in found) <= 1
    assert sum(len(r.text.split()) for r in M.mix_documents(docs, M.Mix(share=0.37)).collect()) == int(total * 0.37)
