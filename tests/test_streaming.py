from __future__ import annotations

import json

import pytest
from brevia.config import EngineConfig
from brevia.functions.text import estimate
from brevia.operators.prune import Turn, roll
from brevia.schema import from_conversations
from brevia.sources.backends import PrefixBackend
from brevia.streaming.rolling import prune_stream, step
from pyspark.sql import functions as F

CONFIG = EngineConfig(prune_budget_tokens=300, prune_keep_recent=2, prune_batch_size=2, prune_chain_max_batches=3)


def test_state_is_bounded_and_order_restored():
    state, sizes = {"next": 0, "covered": 0, "blocks": [], "open": [], "early": {}}, []
    turns = [Turn((t := f"{k} " + "word " * 60,), estimate(t), json.dumps(t)) for k in range(60)]
    for k in range(0, 60, 2):
        state, out = step(state, [(k + 1, turns[k + 1])], PrefixBackend(0.2), CONFIG)
        assert out is None and len(state["early"]) == 1
        state, out = step(json.loads(json.dumps(state)), [(k, turns[k]), (k, turns[k])], PrefixBackend(0.2), CONFIG)
        assert out["next_seq"] == k + 2 == out["covered"] + out["n_open"]
        sizes.append((len(state["open"]), len(state["blocks"])))
    assert max(s for s, _ in sizes) < 15 and max(b for _, b in sizes) <= 3 and state["covered"] > 40


def test_stream(spark, tmp_path):
    rows = [(c, k, "user", f"{c} {k} " + "word " * 60) for c in (1, 2) for k in range(12)]
    schema = "conv_id long, turn long, role string, text string"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 4 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = prune_stream(from_conversations(source), PrefixBackend(0.2), CONFIG).writeStream.format("memory").queryName("pruned").outputMode("append").start()
    try:
        query.processAllAvailable()
        last = {r.conv_id: r for r in spark.sql("SELECT * FROM pruned").orderBy("next_seq").collect()}
    finally:
        query.stop()
    assert {k: r.next_seq for k, r in last.items()} == {1: 12, 2: 12} and all(r.covered + r.n_open == 12 and r.covered > 0 for r in last.values())


@pytest.mark.parametrize(("keep", "overhead", "merge"), [(1, 0, 3), (2, 0, 3), (12, 0, 20), (12, 250, 3), (30, 0, 20)])
def test_stream_and_batch_agree_turn_by_turn(keep, overhead, merge):
    """Every request of a growing conversation: same chain, same tokens, with tool exchanges among the turns."""
    config = EngineConfig(prune_budget_tokens=600, prune_keep_recent=keep, prune_batch_size=4, prune_chain_max_batches=merge)
    backend, state, chain = PrefixBackend(0.2), {"next": 0, "covered": 0, "blocks": [], "open": [], "early": {}}, None
    turns = [Turn((t := f"{k} " + "word " * (20 + 13 * k % 50),), estimate(t), json.dumps(t), is_result=k % 7 == 4, is_call=k % 7 == 3) for k in range(60)]
    for n in range(1, len(turns) + 1):
        state, out = step(json.loads(json.dumps(state)), [(n - 1, turns[n - 1])], backend, config, overhead)
        done = roll(turns[:n], chain, overhead, backend, config)
        chain = done.chain if done else chain
        assert [tuple(b) for b in state["blocks"]] == (chain.blocks if chain else []) and out["covered"] == (chain.covered if chain else 0)
        if done:
            assert (out["after_tokens"], out["newly"]) == (done.after, done.newly)
    assert keep == 30 or chain.covered > 30


def test_overhead_of_a_stream(spark, tmp_path):
    rows = [(1, k, "user", f"{k} " + "word " * 60) for k in range(4)]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    for extra, covered in ((0, 0), (300, 2)):
        source = from_conversations(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).withColumn("overhead", F.lit(extra))
        query = prune_stream(source, PrefixBackend(0.2), CONFIG).writeStream.format("memory").queryName(f"with_{extra}").outputMode("append").start()
        try:
            query.processAllAvailable()
            assert spark.sql(f"SELECT covered FROM with_{extra}").first().covered >= covered and (extra or spark.sql("SELECT covered FROM with_0").first().covered == 0)
        finally:
            query.stop()
