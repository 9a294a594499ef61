"""The engine put together, its SQL functions and renderings."""

from __future__ import annotations

import logging
from dataclasses import replace

import pytest
from brevia import render, sql
from brevia.config import EngineConfig
from brevia.engine import Engine, observed
from brevia.functions import chunking, text
from brevia.operators import distill as D
from brevia.operators import run as U
from brevia.schema import from_conversations
from brevia.sources.backends import FailingBackend, PrefixBackend
from pyspark.sql import Observation
from pyspark.sql import functions as F

TEXTS = ["", "hello", "中文abc", "😀a", "x" * 4000, "line one\nline two\n\nline four", "⟦本地蒸馏·原文10字符·≈9→3 tokens（-67%）⟧\nx", "translate each", None]


def test_sql_functions(spark):
    assert "chunk_text" in sql.register(spark)
    spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").createOrReplaceTempView("texts")
    rows = {r.id: r for r in spark.sql("""SELECT id, estimate_tokens(t) e, utf16_length(t) u, calibrated_tokens(t, 1.25D) c, fnv1a(t) f, content_hash16(t) h, token_chunks(t, 3) k, truncate_text(t, 5) x,
        auto_strategy(t) s, is_marked(t) m, read_distill_mark(first_line(t)) r, trigram_similarity(t, 'hello') j, distill_mark(10, 9, 3) d, savings_percent(10, 13) p, strip_prune_lines(t) q, chunk_verdict(t, 'x') v FROM texts""").collect()}
    for k, t in enumerate(TEXTS):
        r = rows[k]
        if t is None:
            assert r.e == 1 and r.u is None and r.k is None and r.x is None  # a null counts as the empty text
            continue
        assert (r.e, r.u, r.c) == (text.estimate(t), text.u16(t), text.calibrated(t, 1.25)) and r.f == text.fnv1a(t) and r.k == chunking.token_chunks(t, 3) and r.x == chunking.truncate_head_tail(t, 5)[0]
        assert r.j == text.similarity(t, "hello") and r.d == "⟦本地蒸馏·原文10字符·≈9→3 tokens（-67%）⟧" and r.p == -30 and r.s == ("chunk" if "translate" in t else "truncate")
    assert rows[6].m and tuple(rows[6].r) == (10, 9, 3, -67) and rows[1].r is None and rows[1].v == "ok" and rows[0].v == "echo"
    found = spark.sql("SELECT id, pos, chunk FROM texts, LATERAL chunk_text(t, 9) WHERE id = 5 ORDER BY pos").collect()
    assert [r.chunk for r in found] == chunking.chunk_text(TEXTS[5], 9)
    assert "ArrowEvalPython" not in spark.sql("SELECT estimate_tokens(t) FROM texts")._jdf.queryExecution().executedPlan().toString()


CONFIG = EngineConfig(distill_min_chars=300, distill_chunk_chars=100_000, prune_budget_tokens=700, prune_keep_recent=2, prune_batch_size=2, default_model="m")


class Counting:
    def __init__(self, folder):
        self.folder = folder

    def complete(self, task, text, config):
        import uuid

        (self.folder / uuid.uuid4().hex).write_text(task)
        return PrefixBackend(0.3).complete(task, text, config)


def conversations(spark, n, conv=1):
    rows = [(conv, k, "user" if k % 2 == 0 else "assistant", f"{k} says " + f"word{k} " * 70) for k in range(n)]
    return from_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def test_prepare_with_caches(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    requests = spark.createDataFrame([(1, "be brief", "[]")], "conv_id long, system string, tools_json string")
    engine = Engine(spark, replace(CONFIG, distill_cache_path=str(tmp_path / "cache")), Counting(calls))
    first = engine.prepare(conversations(spark, 10), requests, at=1)
    wire = first.messages.orderBy("seq").collect()
    assert first.pruned.first().covered > 0 and first.notices.first().notice_key.startswith("p|") and any(r.changed for r in wire)
    made = len(list(calls.iterdir()))
    again = engine.prepare(conversations(spark, 10), requests, first.notices.select("conv_id", "notice_key"), at=2)
    assert again.messages.orderBy("seq").collect() == wire and again.notices.count() == 0 and again.pruned.first().newly == 0
    assert len(list(calls.iterdir())) == made  # every block and text came from a cache
    other = engine.prepare(conversations(spark, 10, conv=7), requests.withColumn("conv_id", F.lit(7).cast("long")), at=3)
    assert other.pruned.first().block_texts == first.pruned.first().block_texts and len(list(calls.iterdir())) == made  # known by its first message
    later = engine.prepare(conversations(spark, 14), requests, at=4).pruned.first()
    assert later.block_texts[: len(first.pruned.first().block_texts)] == first.pruned.first().block_texts


def test_switches(spark, caplog):
    messages = conversations(spark, 6)
    requests = spark.createDataFrame([(1, None, None)], "conv_id long, system string, tools_json string")
    with caplog.at_level(logging.WARNING, "brevia"):
        engine = Engine(spark, replace(CONFIG, default_model=""))
    assert "no model" in caplog.text and not engine.active
    with pytest.raises(ValueError, match="no model"):
        engine.tools()["distill"](messages)
    off = Engine(spark, replace(CONFIG, enabled=False), PrefixBackend())
    assert off.tools() == {} and off.guidance() == [] and off.prepare(messages, requests).messages.filter("changed").count() == 0
    assert [p for p, _ in Engine(spark, replace(CONFIG, routing_guidance=False)).guidance()] == [160, 162]
    assert Engine(spark, replace(CONFIG, announce_to_agent=False)).guidance() == [] and set(Engine(spark, CONFIG).tools()) == {"list_models", "running_models", "chat", "run_files", "distill"}


def results(spark, rows):
    frame = spark.createDataFrame(rows, "exec_id long, t string")
    block = F.struct(F.lit("text").alias("type"), F.col("t").alias("text"))
    return frame.select("exec_id", F.lit("read").alias("tool_name"), F.lit(False).alias("is_nested"), F.lit("accept").alias("decision_kind"), F.lit(False).alias("has_value"), F.array(block).alias("content"))


def test_results_reuse_first_bytes(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    engine = Engine(spark, replace(CONFIG, distill_cache_path=str(tmp_path / "cache")), Counting(calls))
    long = "some words that repeat " * 30
    one = {r.exec_id: r for r in engine.write_results(results(spark, [(1, long), (2, "short"), (3, long)])).collect()}
    made = len(list(calls.iterdir()))
    assert one[1].changed and one[1].content == one[3].content and not one[2].changed and made >= 1
    two = engine.write_results(results(spark, [(9, long)])).first()
    assert two.content == one[1].content and two.changed and len(list(calls.iterdir())) == made


def test_blocked_requests_are_left_out(spark):
    config = replace(CONFIG, distill_on_error="block", distill_roles=("user",))
    messages = conversations(spark, 2).union(from_conversations(spark.createDataFrame([(2, 0, "user", "short")], "conv_id long, turn long, role string, text string")))
    assert {r.conv_id for r in D.distill_messages(messages, FailingBackend("down"), config).collect()} == {2}
    rows = spark.createDataFrame([(1, "x" * 400), (1, "short"), (2, "short")], "conv_id long, text string")
    done = D.distill(rows, FailingBackend("down"), config)
    assert {(r.status, r.error_code) for r in done.collect()} == {("blocked", D.BLOCKED), ("passed", None)}
    assert [r.conv_id for r in D.sendable(done, "conv_id").collect()] == [2]


def test_any_column_names(spark):
    df = spark.createDataFrame([(1, "x" * 400, "old", "e"), (2, "short", "old", "e"), (3, None, "old", "e")], "id int, content string, status string, error string")
    rows = {r.id: r for r in D.distill(df, PrefixBackend(), CONFIG, text="content").collect()}
    assert rows[1].status == "distilled" and rows[1].content.startswith("⟦") and rows[2].content == "short" and rows[3].content is None and rows[1].error is None
    odd = df.withColumnsRenamed({"content": "text", "status": "content_hash", "error": "known"})
    found = D.distill(odd, PrefixBackend(), CONFIG, cache=spark.createDataFrame([("k", "v")], "content_hash string, content string"))
    assert {r.content_hash for r in found.collect()} == {"old"} and found.count() == 3


def test_text_or_path(spark, tmp_path):
    (tmp_path / "a.txt").write_text("from the file " * 50)
    rows = [(1, "given " * 100, str(tmp_path / "a.txt")), (2, "", str(tmp_path / "a.txt")), (3, None, str(tmp_path / "none")), (4, None, None), (5, "short", None)]
    got = {r.id: r for r in U.distill_any(spark.createDataFrame(rows, "id int, text string, path string"), PrefixBackend(), CONFIG, path="path").withColumn("said", render.distilled_text()).collect()}
    assert not got[1].skipped and "given" in got[1].content and "from the file" in got[2].content and got[2].original_chars == 700
    assert "none" in got[3].error and got[4].error == "no text and no path" and got[5].skipped and "not shortened" in got[5].said and got[1].said.startswith("⟦本地蒸馏") and "failed" in got[3].said


def test_file_tasks_fit_their_window(spark):
    seen = []
    long = "\n".join(f"line {k} of the file" for k in range(2000))
    told = "translate " + "this very long instruction " * 100
    tasks = spark.createDataFrame([(1, long, told, " json "), (2, None, "x", None), (3, "text", " ", None), (4, long, "translate", None), (4, "short", "translate", None)], "id long, content string, instruction string, f string")
    config = EngineConfig(run_max_context_tokens=2000)

    class Longest(Counting):
        def complete(self, task, text, config):
            if task != "merge":
                assert text.startswith("short") or (text.count("\n") and ("json" in task) == ("very long" in task))
            assert task == "merge" or U.estimate(text) + U.estimate(task) <= 2000
            return text[:20]

    done = U.run_over_files(tasks, Longest(None), config, "id", output_format="f").withColumn("said", render.task_text())
    got = [(r.id, r.strategy, r.error) for r in done.collect()]
    assert sorted(got, key=str) == sorted([(1, "chunk", None), (2, None, "no content"), (3, None, "no instruction"), (4, "chunk", None), (4, "full", None)], key=str) and not seen
    assert all(r.said for r in done.collect())


def test_renderings_and_metrics(spark):
    models = spark.createDataFrame([("m", 1.23, "7B", "Q4", "f", "t"), ("a", None, None, None, None, None)], "name string, size_gb double, parameter_size string, quantization string, family string, modified_at string")
    assert render.installed_text(models).first().text.split("\n")[2:] == ["a | - | - | - | -", "m | 7B | Q4 | 1.23 GB | t"] and "no model" in render.installed_text(models.limit(0)).first().text
    running = spark.createDataFrame([("m", 1.0, 0.5, "soon")], "name string, size_gb double, vram_gb double, expires_at string")
    assert "m | 1.0 GB | 0.5 GB | soon" in render.running_text(running).first().text
    reply = spark.createDataFrame([("m", "hi", "hm", 5, 3, 2, 4.5, None), (None, None, None, None, None, None, None, "down")], "reply_model string, reply_content string, reply_thinking string, reply_total_duration_ms long, reply_prompt_tokens long, reply_completion_tokens long, reply_tokens_per_second double, reply_error string")
    said = [r.x for r in reply.select(render.reply_text().alias("x")).collect()]
    assert said == ["(thinking) hm\n\nhi\n\n[m, 3 tokens read, 2 written, 5 ms, 4.5 tokens/s]", "the call failed: down"]
    seen = Observation("distilled")
    done = D.distill(spark.createDataFrame([("x" * 400,), ("s",)], "text string"), PrefixBackend(), CONFIG)
    of = lambda status: F.count_if(F.col("status") == status).alias(status)
    done.observe(seen, of("distilled"), of("passed")).collect()
    assert seen.get == {"distilled": 1, "passed": 1} and observed(done).count() == 2
