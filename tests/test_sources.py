from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from brevia.config import EngineConfig
from brevia.operators import run as U
from brevia.operators.notices import as_events, mark_totals, notices
from brevia.sources import backends as B
from brevia.sources import cache as C
from brevia.sources import files as X
from brevia.sources import models as O
from pyspark.sql import functions as F


class Stub(BaseHTTPRequestHandler):
    seen: list = []

    def answer(self, body, code=200):
        raw = json.dumps(body).encode() if not isinstance(body, bytes) else body
        self.send_response(code)
        self.end_headers()
        self.wfile.write(raw)

    def do_GET(self):
        if self.path == "/api/version":
            self.answer({"version": "1.2"})
        elif self.path == "/api/tags":
            self.answer({"models": [{"name": "m", "size": 1_234_567_890, "details": {"parameter_size": "7B", "quantization_level": "Q4", "family": "f"}, "modified_at": "t"}, {"name": "n"}]})
        elif self.path == "/api/ps":
            self.answer({"models": [{"name": "m", "size": 2e9, "size_vram": 1e9, "expires_at": "e"}]})
        elif self.path == "/slow":
            time.sleep(1)
            self.answer({})
        else:
            self.answer(b"nope", 404)

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["content-length"])))
        Stub.seen.append(body)
        self.answer({"model": body["model"], "message": {"role": "assistant", "content": body["messages"][-1]["content"][:40], "thinking": "hm"}, "total_duration": 2_400_000, "prompt_eval_count": 5, "eval_count": 10, "eval_duration": 500_000_000, "done_reason": "stop"})

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}"
    httpd.shutdown()


def test_catalogue(spark, server):
    rows = O.catalogue(spark, server).orderBy("name").collect()
    assert [tuple(r) for r in rows] == [("m", 1.23, "7B", "Q4", "f", "t"), ("n", None, None, None, None, None)]
    assert O.catalogue(spark, server, "running").first().vram_gb == 1.0 and O.catalogue(spark, server, "version").first().version == "1.2"
    assert O.describe(rows).splitlines()[2] == "m | 7B | Q4 | 1.23 GB | t" and "no model" in O.describe([])


def test_http_errors(server):
    for url, limit, words in ((f"{server}/none", 1000, "404: nope"), (f"{server}/slow", 200, "within 200 ms"), ("http://127.0.0.1:1/x", 1000, "running?")):
        with pytest.raises(B.BackendError, match=words.replace("?", r"\?")):
            B.request_json(url, None, limit)


def test_chat_and_backend(server):
    reply = B.chat(server, "m", [{"role": "user", "content": "hello"}])
    assert (reply["content"], reply["total_duration_ms"], reply["tokens_per_second"]) == ("hello", 2, 20.0) and "options" not in Stub.seen[-1] and "think" not in Stub.seen[-1]
    text = "x" * 1000
    assert B.HttpBackend(server, "m").complete("chunk", text, EngineConfig()) == "x" * 40
    assert Stub.seen[-1]["options"] == {"temperature": 0, "seed": B.fnv1a(text), "num_predict": 400, "num_ctx": 8192} and Stub.seen[-1]["think"] is False


def test_chat_rows(spark, server):
    schema = "id long, prompt string, messages array<struct<role:string,content:string>>, system string, files string, temperature double"
    rows = [(1, "hi", None, "be kind", "FILE", 0.5), (2, None, [("user", "m")], "unused", None, None), (3, " ", None, None, None, None)]
    got = {r.id: r for r in U.chat_rows(spark.createDataFrame(rows, schema), server, "m").collect()}
    assert got[1].reply_content == "hi" and got[2].reply_content == "m" and "no prompt" in got[3].reply_error
    assert any([m["role"] for m in x["messages"]] == ["system", "system", "user"] and x["options"] == {"temperature": 0.5} for x in Stub.seen)
    assert U.chat_rows(spark.createDataFrame(rows[:1], schema), server, "").first().reply_error == "no model"


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("alpha")
    (tmp_path / "b.txt").write_text("b" * (X.MAX_UNITS + 7))
    paths = [f" {tmp_path}/a.txt ", "", None, f"{tmp_path}/b.txt", f"{tmp_path}/none.txt"]
    got = X.read_files(spark, paths)
    assert [r.error is None for r in got.orderBy("path").collect()] == [True, True, False]
    block = X.files_block(got.withColumn("g", F.lit(1)), ["g"]).first()
    assert block.n_files == 3 and "===== FILE 1/3: " in block.block and "alpha" in block.block and "7 characters left out" in block.block and "[not readable]" in block.block
    df = spark.createDataFrame([([" a ", "", None, "﻿b　"],), (None,)], "p array<string>")
    assert [r.x for r in df.select(X.normalise_paths(F.col("p")).alias("x")).collect()] == [["a", "b"], []]


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert C.load(spark, path).count() == 0
    first = spark.createDataFrame([("a", "1", 1), ("b", "2", 2), (None, "x", 3)], C.SCHEMA)
    C.save(first, path)
    assert C.load(spark, path).count() == 2
    fresh = spark.createDataFrame([("a", "other", 9), ("c", "3", 5)], C.SCHEMA)
    merged = C.merge(C.load(spark, path), fresh, 2)
    assert sorted(map(tuple, merged.collect())) == [("b", "2", 2), ("c", "3", 5)]
    C.save(merged, path)
    assert {r.content_hash for r in C.load(spark, path).collect()} == {"b", "c"}


@pytest.mark.parametrize("n", [3, 10, 11, 12, 15, 16, 23])
def test_half_flush(spark, n):
    held: dict = {}
    for k in range(n):
        if len(held) >= 10:
            for key in list(held)[:5]:
                del held[key]
        held[f"k{k:02}"] = k
    entries = spark.createDataFrame([(f"k{k:02}", k) for k in range(n)], "content_hash string, inserted long")
    assert {r.content_hash for r in C.evict_half(entries, 10).collect()} == set(held)


def test_run_plan_and_strategies(spark):
    words = {"Please SUMMARize": "distill", "translate it": "chunk", "请翻译": "chunk", "count": "truncate", "a digest of each": "distill"}
    df = spark.createDataFrame([(w,) for w in words], "i string").select("i", U.auto_strategy(F.col("i")).alias("s"))
    assert {r.i: r.s for r in df.collect()} == words
    wished = spark.createDataFrame([("do", " json "), ("do", None)], "i string, f string").select(U.with_format(F.col("i"), F.col("f")).alias("x"))
    assert [r.x for r in wished.collect()] == ["do\n\nGive the result in this format: json.", "do"]


def test_run_over_files(spark):
    long = "\n".join(f"line {k} of the file" for k in range(2000))
    tasks = spark.createDataFrame([(1, "short", "x"), (2, long, "translate"), (3, long, "summarise"), (4, long, "count")], "id long, content string, instruction string")
    config = EngineConfig(run_max_context_tokens=1200)
    got = {r.id: r for r in U.run_over_files(tasks, B.PrefixBackend(0.5), config, "id").collect()}
    assert [got[k].strategy for k in (1, 2, 3, 4)] == ["full", "chunk", "distill", "truncate"] and got[2].n_parts > 5 and all(r.answer for r in got.values())
    failed = {r.id: r.error for r in U.run_over_files(tasks, B.FailingBackend("down"), config, "id").collect()}
    assert failed == dict.fromkeys((1, 2, 3, 4), "down")


def test_notices(spark):
    pruned = spark.createDataFrame([(1, 4, 6, 1000, "ck")], "conv_id long, covered int, newly int, before_tokens long, chain_key string")
    fresh = spark.createDataFrame([(2, "⟦本地蒸馏·原文10字符·≈9→3 tokens（-67%）⟧", "h1"), (2, "⟦本地蒸馏·odd", "h2")], "conv_id long, mark string, content_hash string")
    sums = spark.createDataFrame([(k, 10, 0, 100, 290, 400) for k in (1, 2, 3)], "conv_id long, system_tokens long, tools_tokens long, history_tokens long, conversation_tokens long, total_tokens long")
    rows = {r.conv_id: r for r in notices(pruned, fresh, sums, EngineConfig()).collect()}
    assert set(rows) == {1, 2} and rows[1].notice_key == "p|ck" and "60 % saved" in rows[1].summary and rows[2].notice_key == "m|h1,h2" and "2 texts" in rows[2].summary
    sent = notices(pruned, fresh, sums, EngineConfig()).select("conv_id", "notice_key")
    assert notices(pruned, fresh, sums, EngineConfig(), sent).count() == 0
    assert notices(pruned, fresh, sums, EngineConfig(distill_notice_always=True)).count() == 3
    assert {r.conv_id for r in notices(pruned, fresh, sums, EngineConfig(prune_notice=False)).collect()} == {2}
    assert as_events(notices(pruned, fresh, sums, EngineConfig())).first().op == "append"
    total = mark_totals(fresh.select("conv_id", "mark"), "conv_id").first()
    assert (total.n_marks, total.n_parsed, total.card_text) == (2, 1, "⟦本地蒸馏·原文10字符·≈9→3 tokens（-67%）⟧")
