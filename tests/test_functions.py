from __future__ import annotations

import random

import pytest
from brevia.functions import chunking as K
from brevia.functions import markers as M
from brevia.functions import text as T
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

GOLDEN = [("", 1, 2166136261), ("hello", 1, 1335831723), ("中文abc", 3, 664099203), ("😀a", 1, 3092832667), ("𠀀", 1, 3072481677), ("x" * 4000, 1120, 1676640837)]


@pytest.mark.parametrize(("text", "tokens", "seed"), GOLDEN)
def test_golden_values(text, tokens, seed):
    assert T.estimate(text) == tokens and T.fnv1a(text) == seed


def test_columns_equal_python(spark):
    draw = random.Random(2)
    texts = [t for t, _, _ in GOLDEN] + ["".join(draw.choice("ab 中豈가😀\n") for _ in range(draw.randint(0, 40))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    rows = df.select("t", T.u16_len(c).alias("u"), T.estimate_tokens(c).alias("e"), T.calibrated_tokens(c, 1.25).alias("k"), T.fingerprint(c).alias("f"), T.fingerprint36(c).alias("b")).collect()
    for r in rows:
        assert (r.u, r.e, r.k, r.f, r.b) == (T.u16(r.t), T.estimate(r.t), T.calibrated(r.t, 1.25), T.fnv1a(r.t), T.base36(T.fnv1a(r.t)))
    assert T.base36(T.fnv1a('"a中b12"')) == "305qei"


def test_similarity(spark):
    assert T.similarity("abcdefgh", "abcdefxx") == 0.5 and T.similarity("", "ab") == 1.0 and T.similarity("abc", "") == 0.0
    pairs = [("abcdefgh", "abcdefxx"), ("", "ab"), ("abc", ""), ("aaaa", "aaa")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.set_similarity(T.trigram_set(F.col("a")), T.trigram_set(F.col("b"))).alias("s"))
    assert all(r.s == T.similarity(r.a, r.b) for r in df.collect())


def test_rounding_is_half_up(spark):
    values = [-0.5, 0.5, 1.5, -1.5, 2.4]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(T.rounded(F.col("v")).alias("x")).collect()]
    assert got == [T.round_half_up(v) for v in values] == [0, 1, 2, -1, 2]


# --- chunks --------------------------------------------------------------------------------------------


def reference_chunks(text, most):
    """The rule said line by line: a piece grows while the next line fits; nothing longer than most is held."""
    if len(text) <= most:
        return [text]
    out, piece = [], ""
    for line in text.split("\n"):
        if piece and len(piece) + 1 + len(line) > most:
            out.append(piece)
            piece = ""
        piece = f"{piece}\n{line}" if piece else line
        while len(piece) > most:
            out.append(piece[:most])
            piece = piece[most:]
    return out + [piece] * bool(piece)


@settings(max_examples=300, deadline=None)
@given(st.text("ab\n ", max_size=80), st.integers(1, 12))
def test_chunks_equal_the_rule(text, most):
    got = K.chunk_text(text, most)
    assert got == reference_chunks(text, most) and (len(text) <= most or all(0 < len(x) <= most for x in got))


def test_astral_characters_stay_whole():
    got = K.chunk_text("😀" * 10, 5)
    assert "".join(got) == "😀" * 10 and all(T.u16(x) <= 5 for x in got)


@settings(max_examples=200, deadline=None)
@given(st.text("ab中\n ", max_size=120), st.integers(2, 9))
def test_token_chunks_keep_everything_within_budget(text, budget):
    got = K.token_chunks(text, budget)
    assert all(T.estimate(x) <= budget for x in got)
    assert "".join(got).replace("\n", "") == text.replace("\n", "")


def test_truncation_keeps_both_ends():
    text = "\n".join(f"line number {k}" for k in range(500))
    content, cut, whole = K.truncate_head_tail(text, 200)
    head, tail = content.split(K.TRUNCATED)
    assert cut and whole == T.estimate(text) and text.startswith(head) and text.endswith(tail) and tail.count("\n") > 3
    assert T.estimate(head) <= 120 and K.truncate_head_tail("short", 200) == ("short", False, 1)


def test_table_function(spark):
    spark.udtf.register("chunk_text", K.ChunkText)
    rows = spark.sql("SELECT d.id, c.pos, c.chunk FROM VALUES (1, 'ab\ncd\nef'), (2, 'x') AS d(id, t), LATERAL chunk_text(d.t, 5) c").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "ab\ncd"), (1, 1, "ef"), (2, 0, "x")]


# --- markers -------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("before", "after", "sign"), [(1721, 503, "-71"), (100, 120, "+20"), (10, 10, "-0")])
def test_markers_round_trip(spark, before, after, sign):
    block = M.distill_block(6146, before, after, "a\nb")
    df = spark.createDataFrame([(6146, before, after, "a\nb")], "c long, b long, a long, s string")
    row = df.select(M.distill_block_column(*(F.col(x) for x in "cbas")).alias("x")).withColumn("m", M.read_mark(M.mark_line(F.col("x")))).first()
    assert row.x == block and f"（{sign}%）" in block
    assert tuple(row.m) == (6146, before, after, int(sign)) and block.endswith(M.DISTILL_CLOSE)


def test_strip_prune_lines(spark):
    block = M.prune_block(4, 2, 100, 20, "one\ntwo")
    assert M.strip_prune_lines(block) == "one\ntwo"
    df = spark.createDataFrame([(block,)], "b string").select(M.strip_prune_lines_column(F.col("b")).alias("x"), M.is_marked(F.col("b")).alias("y"))
    assert tuple(df.first()) == ("one\ntwo", True)
