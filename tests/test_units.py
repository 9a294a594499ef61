"""Lengths in UTF-16 units, hot keys, and sequential operators against plain versions."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from brevia.config import EngineConfig
from brevia.functions import text as T
from brevia.operators import accounting as A
from brevia.operators import distill as D
from brevia.operators import prune as P
from brevia.operators import results as R
from brevia.operators import session as Z
from brevia.sources import cache as C
from brevia.sources import files as X
from brevia.sources.backends import PrefixBackend
from pyspark.sql import functions as F

ASTRAL = ["", "abc", "a😀b😀", "😀" * 40, "x" * 9 + "😀" + "y" * 9, "中文😀字"]


def units(text):
    return len(text.encode("utf-16-le")) // 2


@pytest.mark.parametrize("most", [1, 2, 3, 10, 11, 30])
def test_cuts_by_units(spark, most):
    df = spark.createDataFrame([(t,) for t in ASTRAL], "t string")
    for r in df.select("t", T.u16_left(F.col("t"), most).alias("l"), T.u16_right(F.col("t"), F.lit(most)).alias("r")).collect():
        assert r.t.startswith(r.l) and r.t.endswith(r.r) and T.u16_tail(r.t, most) == r.r
        for part in (r.l, r.r):
            assert units(part) <= most and (units(part) >= most - 1 or part == r.t)


def test_units_in_files_sources_and_trigrams(spark):
    long = "😀" * (X.MAX_UNITS // 2) + "ab"
    df = spark.createDataFrame([(0, "b", long), (1, "a", "x")], "pos int, path string, content string").withColumn("g", F.lit(1))
    block = X.files_block(df, ["g"]).first().block
    assert "2 characters left out" in block and "a" not in block.split("=====\n")[1].split("\n")[0] and block.index("FILE 1/2: b") < block.index("FILE 2/2: a")
    config = EngineConfig(prune_max_source_chars=1500)
    rows = spark.createDataFrame([(1, 0, "a" * 100), (1, 1, "😀" * 1500)], "conv_id long, seq long, text string")
    assert P.source_window(rows, config).first().source == P.source_text([P.Turn(("a" * 100,), 1, ""), P.Turn(("😀" * 1500,), 1, "")], 1500) == "😀" * 750
    assert P.whole_block_window(rows, 3100).first().n_taken == 2 and P.whole_block_window(rows, 3050).first().n_taken == 1
    pairs = spark.createDataFrame([("a😀b😀", "a😀bc"), ("abcdefgh", "abcdefxx"), ("", "x"), ("😀" * 900, "😀" * 749 + "zz")], "a string, b string")
    for r in pairs.select("a", "b", T.set_similarity(T.trigram_set(F.col("a")), T.trigram_set(F.col("b"))).alias("s")).collect():
        assert r.s == T.similarity(r.a, r.b)


def test_frames_are_joined_before_lines_are(spark, tmp_path):
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    (tmp_path / "log.zst").write_bytes(pack('{"a": "x y\x85z"}\n{"b":'.encode()) + pack(b" 1}\n\nlast"))
    assert [r.line for r in Z.read_frames(spark, str(tmp_path / "log.zst")).collect()] == ['{"a": "x y\x85z"}', '{"b": 1}', "", "last"]


def test_fold_equals_list_operations(spark):
    draw = random.Random(3)
    rows, want = [], []
    for session in range(40):
        surface = []
        for seq in range(draw.randint(1, 60)):
            start, end = (draw.randint(-2, seq + 1) for _ in range(2)) if draw.random() < 0.4 else (None, None)
            op = "append" if start is None else "replace"
            rows.append((session, seq, "m", "user", f"{seq}", op, start, end))
            if op == "replace" and start in surface:
                first = surface.index(start)
                last = surface.index(end) if end in surface else first
                surface[first : max(first, last) + 1] = [seq]
            else:
                surface.append(seq)
        want += [(session, k, seq) for k, seq in enumerate(surface)]
    found = Z.fold(spark.createDataFrame(rows, "session long, seq long, type string, role string, text string, op string, start long, end long"))
    assert sorted((r.session, r.place, r.seq) for r in found.collect()) == sorted(want)


def test_guard_equals_its_rule():
    """Back over results, then over calls; if that leaves nothing, on to the end of the exchange, never past the last turn."""

    def rule(turns, start, end):
        at = end
        while at > start and P.parts_exchange(turns, at):
            at -= 1
        if at > start:
            return at
        at = end
        while at < len(turns) and P.parts_exchange(turns, at):
            at += 1
        return at if at < len(turns) else start

    draw = random.Random(9)
    for _ in range(5000):
        turns = [P.Turn((), 1, "", draw.random() < 0.4, draw.random() < 0.3) for _ in range(draw.randint(2, 14))]
        start = draw.randint(0, len(turns) - 2)
        end = draw.randint(start + 1, len(turns) - 1)
        assert P.guard(turns, start, end) == rule(turns, start, end)


def test_one_hot_key(spark):
    """Windows whose frames only grow: a key with very many rows takes linear time."""
    n = 100_000
    calls = spark.range(n).select(F.lit(1).alias("conv_id"), F.lit("x").alias("call_id"), (F.col("id") * 2).alias("seq"))
    pairs = Z.tool_pairs(calls, calls.withColumn("seq", F.col("seq") + 1))
    assert pairs.filter("result_seq = call_seq + 1").count() == n
    priced = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("seq"), F.lit(2).cast("long").alias("tokens"))
    assert A.positions(priced, EngineConfig()).filter(f"suffix_tokens = 2 * ({n} - seq)").count() == n
    texts = spark.range(n).select("id", F.when(F.col("id") % 3 > 0, "the same").otherwise(F.col("id").cast("string")).alias("t"))
    first = R.first_written(texts, "t", "id")
    assert first.filter("t = 'the same' and first_at = 1").count() == n - n // 3 - 1 and first.filter("t <> 'the same' and first_at <> id").count() == 0
    done = D.distill(texts.withColumn("text", F.when(F.col("id") % 10 == 0, F.repeat(F.lit("long text "), F.lit(300))).otherwise("short")), PrefixBackend(), EngineConfig(distill_chunk_chars=10_000))
    assert {r.status: r["count"] for r in done.groupBy("status").count().collect()} == {"passed": n - n // 10, "distilled": n // 10}
    assert "Union" in done._jdf.queryExecution().optimizedPlan().toString()  # what passes isn't shuffled to meet under a null key


def test_null_texts_reuse(spark):
    rows = R.first_written(spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, t string"), "t", "id")
    assert {r.id: r.first_at for r in rows.collect()} == {1: 1, 2: 1, 3: 3}


def test_owner_follows_the_agents_order(spark):
    requests = spark.createDataFrame([(1, 0, 10), (1, 1, 20)], "request_id long, seq long, message_id long")
    events = spark.createDataFrame([("b", 1, 20), ("a", 2, 10), ("c", 0, 99)], "agent string, seq long, message_id long")
    assert Z.owner(requests, events).first().agent == "b"
    order = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "agent string, place int")
    assert Z.owner(requests, events, order).first().agent == "a"
    assert Z.owner(requests, events, order, window=0).first().agent is None


def test_wire_and_result_order(spark):
    from tests.test_operators import block, messages

    rows = [
        (1, 0, "user", [block("text", text="q")]), (1, 1, "assistant", [block("reasoning", text="why"), block("tool-call", id="a", arguments="{}"), block("tool-call", id="b", arguments="{}")]),
        (1, 2, "user", [block("tool-result", tool_call_id="b", content=[block("text", text="r")])]), (1, 3, "tool", [block("tool-result", tool_call_id="a")]), (1, 4, "tool", [block("text", text="no call")]),
        (1, 5, "user", [block("text", text="next")]), (1, 6, "user", [block("tool-result", tool_call_id="a")]), (2, 0, "user", [block("tool-result", tool_call_id="z")]),
        (2, 1, "assistant", [block("reasoning", text="kept out"), block("text", text="plain")]),
    ]
    df = messages(spark, rows)
    assert sorted((r.conv_id, r.seq, r.call_id, r.valid) for r in Z.wire_order(df).collect() if r.call_id) == [(1, 2, "b", True), (1, 3, "a", True), (1, 6, "a", False), (2, 0, "z", False)]
    assert [(r.seq, r.valid) for r in Z.wire_order(df).collect() if not r.call_id] == [(4, False)]
    requests = spark.createDataFrame([(1, "sys", "[1]"), (2, None, None)], "conv_id long, system string, tools_json string")
    wires = {r.conv_id: r.wire.split("\0") for r in Z.wire_text(df, requests).collect()}
    assert wires[1] == ["SYS:sys", "TOOLS:[1]", "user{t:q}", "assistant{r:why|a:{}|a:{}}", "user{t:r}", "tool{}", "tool{t:no call}", "user{t:next}", "user{}"] and wires[2] == ["SYS:", "user{}", "assistant{t:plain}"]


def test_legacy_calls_and_chained_candidates(spark):
    df = spark.createDataFrame([(1, 0, "assistant", ["c"]), (1, 1, "user", []), (1, 2, "assistant", None)], "conv_id long, seq long, role string, tool_calls array<string>")
    from brevia.schema import text_block

    turns = P.turns_of(df.withColumn("content", F.array(text_block(F.lit("x")))), EngineConfig()).orderBy("seq").collect()
    assert [r.is_call for r in turns] == [True, False, False]
    priced = spark.createDataFrame([(c, k, 10) for c in (1, 2) for k in range(20)], "conv_id long, seq long, tokens long")
    found = A.prune_candidates(priced, EngineConfig(), spark.createDataFrame([(2,)], "conv_id long"))
    assert {r.conv_id: r.eligible for r in found.collect()} == {1: False, 2: True} and not A.prune_candidates(priced, EngineConfig()).filter("eligible").count()


def test_snapshots_know_conversations_by_their_first_message(spark):
    from brevia.schema import from_conversations

    config = replace(EngineConfig(), prune_budget_tokens=300, prune_keep_recent=2, prune_batch_size=2)
    turns = lambda conv, n: from_conversations(spark.createDataFrame([(conv, k, "user", f"{k} " + "word " * 60) for k in range(n)], "conv_id long, turn long, role string, text string"))
    first = P.prune_history(turns(1, 8), PrefixBackend(0.2), config)
    kept = P.snapshots(turns(1, 8), first)
    later = P.prune_history(turns(5, 10), PrefixBackend(0.2), config, P.recall(turns(5, 10), kept)).first()
    row = first.first()
    assert later.block_texts[: len(row.block_texts)] == row.block_texts and later.covered > row.covered and set(row.known_keys) <= set(later.known_keys)


def test_cache_swap_leaves_one_older_table(spark, tmp_path):
    path = str(tmp_path / "cache")
    for k in range(4):
        C.save(spark.createDataFrame([(f"k{k}", "x", k)], C.SCHEMA), path)
        assert C.load(spark, path).first().content_hash == f"k{k}"
    assert len(list((tmp_path / "cache").glob("v-*"))) == 2 and (tmp_path / "cache" / "CURRENT").is_file()
    for gone in (tmp_path / "cache").glob("v-*"):
        for part in gone.iterdir():
            part.unlink()
        gone.rmdir()
    assert C.load(spark, path).count() == 0  # can't be read: empty, and a warning
