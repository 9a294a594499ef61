from __future__ import annotations

import json
import random
from dataclasses import replace

import pytest
from brevia.config import EngineConfig
from brevia.functions import markers as M
from brevia.functions.text import estimate
from brevia.operators import accounting as A
from brevia.operators import distill as D
from brevia.operators import prune as P
from brevia.operators import results as R
from brevia.operators import session as Z
from brevia.schema import BLOCK, MESSAGE
from brevia.sources.backends import BackendError, ExtractiveBackend, FailingBackend, PrefixBackend
from pyspark.sql import functions as F

CONFIG = EngineConfig(distill_min_chars=100, distill_chunk_chars=200)
NOISY = "\n".join([f"heartbeat {k} ok" for k in "abcdefghijklmnopqrstuvwxyz"] + ["error E1042 in /srv/app/main.py"])


class Counting:
    def __init__(self, inner):
        self.inner, self.calls = inner, 0

    def complete(self, task, text, config):
        self.calls += 1
        return self.inner.complete(task, text, config)


# --- distillation --------------------------------------------------------------------------------------


def test_fidelity_rules(spark):
    assert D.accept_chunk("x" * 100, " short but fine ") == "short but fine" and D.accept_chunk("abc", "abcd") == "abc"
    for answer in ("", "  ", "x"):
        with pytest.raises(BackendError):
            D.accept_chunk("x" * 100, answer)
    with pytest.raises(BackendError):
        D.accept_history("abc", "abc")
    with pytest.raises(BackendError):
        D.accept_history("x" * 10_000, "y" * 79)
    assert D.accept_history("x" * 3000, "y" * 60) == "y" * 60


def test_facts_survive_and_repeats_go():
    status, content, error, before, after = D.distill_one(NOISY, ExtractiveBackend(0.6), replace(CONFIG, distill_chunk_chars=5000))
    assert status == "distilled" and "E1042" in content and after < 0.8 * before and error is None and content.startswith(M.DISTILL_PREFIX)
    text = "\n".join(["the same long line of an article that was pasted again and again " * 3] * 5)
    assert D.distill_text(text, PrefixBackend(0.5), CONFIG).count("\n\n") < len(D.chunk_text(text, 200)) - 1


def test_echoes_end_the_calls():
    text = "\n".join(f"entry_{k} = value" for k in range(600))
    backend = Counting(PrefixBackend(1.0))
    assert D.distill_text(text, backend, CONFIG) == text and backend.calls == 2
    assert D.distill_one(text, PrefixBackend(1.0), CONFIG)[0] == "unchanged"


@pytest.mark.parametrize(("policy", "status"), [("pass", "failed"), ("block", "blocked")])
def test_failures_are_rows(spark, policy, status):
    df = spark.createDataFrame([(1, NOISY), (2, "short"), (3, None)], "id long, text string")
    rows = {r.id: r for r in D.distill(df, FailingBackend("down"), replace(CONFIG, distill_on_error=policy)).collect()}
    assert (rows[1].status, rows[1].content, rows[1].error) == (status, NOISY, "down") and rows[2].status == rows[3].status == "passed"


def test_gate_cache_and_idempotence(spark):
    df = spark.createDataFrame([(1, NOISY), (2, NOISY), (3, "short"), (4, M.distill_block(1, 2, 1, "x" * 500))], "id long, text string")
    once = D.distill(df, PrefixBackend(), CONFIG)
    rows = {r.id: r for r in once.collect()}
    assert rows[1].content == rows[2].content != NOISY and {rows[3].status, rows[4].status} == {"passed"}
    again = D.distill(once.select("id", F.col("content").alias("text")), PrefixBackend(), CONFIG).collect()
    assert {r.status for r in again} == {"passed"} and {r.id: r.content for r in again} == {k: r.content for k, r in rows.items()}
    cache = df.filter("id = 1").select(D.content_key(F.col("text"), CONFIG).alias("content_hash"), F.lit("from cache").alias("content"))
    hit = {r.id: r for r in D.distill(df, FailingBackend(), CONFIG, cache=cache).collect()}
    assert hit[1].status == hit[2].status == "cached" and hit[2].content == "from cache"
    assert D.config_key(CONFIG) != D.config_key(replace(CONFIG, target_ratio=0.2))
    assert {r.status for r in D.distill(df, PrefixBackend(), replace(CONFIG, distill_enabled=False)).collect()} == {"passed"}


def test_call_budget(spark):
    other = NOISY.replace("heartbeat", "ping")
    turns = [(1, 0, "user", NOISY), (1, 1, "user", other), (1, 2, "user", NOISY), (2, 0, "user", other + "!"), (2, 1, "assistant", NOISY), (2, 2, "user", other)]
    rows = D.distill_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), PrefixBackend(), replace(CONFIG, distill_call_budget=1)).collect()
    assert {(r.conv_id, r.turn): r.status for r in rows} == {(1, 0): "distilled", (1, 1): "over_budget", (1, 2): "distilled", (2, 0): "distilled", (2, 1): "passed", (2, 2): "over_budget"}


def block(kind, **more):
    return {"type": kind} | more


def messages(spark, rows):
    """rows: (conv_id, seq, role, [blocks])."""
    raw = spark.createDataFrame([(c, s, r, json.dumps(b)) for c, s, r, b in rows], "conv_id long, seq long, role string, j string")
    from brevia.schema import SOURCE

    return raw.select("conv_id", "seq", "role", F.from_json("j", f"array<{BLOCK}>").alias("content"), F.lit(None).cast(SOURCE).alias("source"))


def test_nested_blocks_are_distilled(spark):
    df = messages(spark, [(1, 0, "user", [block("text", text="hi"), block("tool-result", tool_call_id="a", content=[block("text", text=NOISY), block("text", text="x")])]), (1, 1, "assistant", [block("text", text=NOISY)])])
    rows = {r.seq: r for r in D.distill_messages(df, PrefixBackend(), CONFIG).collect()}
    held = rows[0].content[1].content
    assert rows[0].changed and held[0].text.startswith(M.DISTILL_PREFIX) and held[1].text == "x" and rows[0].content[0].text == "hi" and rows[0].content[1].tool_call_id == "a"
    assert not rows[1].changed and rows[1].content[0].text == NOISY


# --- accounting ----------------------------------------------------------------------------------------


def test_billing(spark):
    long, args = "x" * 4000, '{"a": "%s"}' % ("y" * 2000)
    rows = [
        (1, 0, "assistant", [block("text", text=long), block("reasoning", text=long)]), (2, 0, "assistant", [block("text", text=long), block("reasoning", text=long), block("tool-call", id="1", arguments=args)]),
        (3, 0, "user", [block("reasoning", text=long), block("tool-result", content=[block("text", text=long), block("reasoning", text=long)])]), (4, 0, "user", [block("text", text="")]), (5, 0, "user", []),
    ]
    got = {r.conv_id: r.tokens for r in A.message_tokens(messages(spark, rows), EngineConfig()).collect()}
    assert got == {1: estimate(long), 2: 2 * estimate(long) + estimate(args), 3: estimate(long), 4: 1, 5: 0}


def test_flattened_texts(spark):
    rows = [(1, 0, "user", [block("text", text="a"), block("text", text=""), block("tool-result", content=[block("text", text="b"), block("image")]), block("tool-result"), block("text", text="c")])]
    assert messages(spark, rows).select(A.flattened_texts(F.col("content")).alias("x")).first().x == ["a", "b", "c"]


def test_result_admission(spark):
    text = {"type": "text", "text": "x" * 150}
    base = dict(exec_id=0, tool_name="read", is_nested=False, decision_kind="accept", has_value=False, content=[text])
    odd = [{}, dict(is_nested=True), dict(tool_name="local_model_run"), dict(decision_kind="block"), dict(has_value=True), dict(content=[text, {"type": "image", "text": None}]), dict(content=[]), dict(content=[{"type": "text", "text": "x" * 60}] * 2)]
    rows = [{**base, **o, "exec_id": k} for k, o in enumerate(odd)]
    df = spark.createDataFrame(rows, "exec_id long, tool_name string, is_nested boolean, decision_kind string, has_value boolean, content array<struct<type:string,text:string>>")
    got = {r.exec_id: r.a for r in df.select("exec_id", R.admitted(CONFIG).alias("a")).collect()}
    assert got == {k: k in (0, 7) for k in range(len(odd))}
    done = {r.exec_id: r for r in R.distill_results(df, PrefixBackend(), CONFIG).collect()}
    assert [k for k, r in done.items() if r.changed] == [0] and done[0].content[0].text.startswith(M.DISTILL_PREFIX)


# --- pruning -------------------------------------------------------------------------------------------


def turn(text, **more):
    return P.Turn((text,), estimate(text), json.dumps([{"type": "text", "text": text}], ensure_ascii=False), **more)


def dialog(n, size=350, start=0):
    return [turn(f"{k}:" + "文" * size) for k in range(start, start + n)]


SMALL = EngineConfig(prune_budget_tokens=1000, prune_roll_margin=1.0, prune_keep_recent=2, prune_batch_size=4)


def test_prune_basic():
    turns = [*dialog(4), turn("short one"), turn("short two")]
    done = P.roll(turns, None, 0, PrefixBackend(0.2), SMALL)
    assert done.chain.covered == 4 and len(done.chain.blocks) == 1 and "省略4条消息·保留最近2条" in done.chain.blocks[0][1]
    again = P.roll(turns, done.chain, 0, FailingBackend(), SMALL)
    assert again.chain == done.chain and again.newly == 0 and not again.rolled


@pytest.mark.parametrize("case", ["under", "few", "off", "down", "overhead"])
def test_prune_leaves_requests_alone(case):
    turns = {"under": dialog(3, 50), "few": dialog(2, 5000)}.get(case, dialog(6))
    config = replace(SMALL, prune_enabled=case != "off")
    if case == "overhead":
        assert P.roll(dialog(6, 100), None, 0, PrefixBackend(0.2), config) is None and P.roll(dialog(6, 100), None, 900, PrefixBackend(0.2), config)
    else:
        assert P.roll(turns, None, 0, FailingBackend() if case == "down" else PrefixBackend(0.2), config) is None


def test_blocks_are_frozen_and_chains_bounded():
    config = replace(SMALL, prune_budget_tokens=1100)
    first = P.roll(dialog(6), None, 0, PrefixBackend(0.2), config)
    later = P.roll(dialog(10), first.chain, 0, PrefixBackend(0.2), config)
    assert later.chain.blocks[: len(first.chain.blocks)] == first.chain.blocks and later.chain.covered < 10
    tight = replace(SMALL, prune_budget_tokens=100, prune_batch_size=1, prune_chain_max_batches=3)
    chain, sizes = None, []
    for n in range(4, 16):
        done = P.roll(dialog(n), chain, 0, PrefixBackend(0.3), tight)
        chain = done.chain
        sizes.append(len(chain.blocks))
        assert chain.covered <= n - 1
    assert max(sizes) <= 3 and any(b < a for a, b in zip(sizes, sizes[1:], strict=False))
    assert P.roll([turn("other"), *dialog(9, start=1)], first.chain, 0, PrefixBackend(0.2), config).chain.blocks != first.chain.blocks


def test_hysteresis_rolls_to_the_plain_budget():
    config = replace(SMALL, prune_budget_tokens=1000, prune_roll_margin=1.5, prune_batch_size=1)
    assert P.roll(dialog(4), None, 0, PrefixBackend(0.1), config) is None
    assert P.roll(dialog(5), None, 0, PrefixBackend(0.1), config).after <= 1000


def test_source_keeps_order_and_newest():
    turns = [P.Turn(("old",), 1, "1"), P.Turn(("first", "second"), 1, "2"), P.Turn(("last",), 1, "3")]
    assert P.source_text(turns, 100) == "old\n\nfirst\n\nsecond\n\nlast" and P.source_text(turns, 12) == "st\n\nsecond\n\nlast"


def test_guard_never_parts_an_exchange():
    draw = random.Random(424242)
    for _ in range(20_000):
        turns = []
        for _ in range(draw.randint(2, 20)):
            if draw.random() < 0.25:
                turns.append(turn("call", is_call=True))
                turns += [turn("result", is_result=True)] * draw.randint(1, 3)
            else:
                turns.append(turn("plain"))
        start = draw.randint(0, len(turns) - 1)
        while turns[start].is_result:
            start -= 1
        end = P.guard(turns, start, min(start + draw.randint(1, 12), len(turns) - 1))
        assert start <= end <= len(turns) - 1 and (end == start or not turns[end].is_result)


def test_prune_frames(spark):
    rows = [(c, k, "user", [block("text", text=f"{k}:" + "文" * 350)]) for c in (1, 2) for k in range(6 if c == 1 else 2)]
    df = messages(spark, rows)
    pruned = P.prune_history(df, PrefixBackend(0.2), SMALL).cache()
    assert [r.conv_id for r in pruned.collect()] == [1]
    done = P.roll(P.read_turns(P.turns_of(df.filter("conv_id = 1"), SMALL).toPandas()), None, 0, PrefixBackend(0.2), SMALL)
    row = pruned.first()
    assert list(zip(row.block_keys, row.block_texts, strict=True)) == done.chain.blocks and row.after_tokens == done.after
    sent = P.assemble(df, pruned).orderBy("conv_id", "seq").collect()
    assert [r.conv_id for r in sent] == [1] * (len(row.block_texts) + 6 - row.covered) + [2, 2] and sent[0].source.kind == "plugin"
    again = P.prune_history(df, FailingBackend(), SMALL, chains=pruned).first()
    assert (again.block_texts, again.newly) == (row.block_texts, 0)
    total = A.message_tokens(P.assemble(df, pruned), SMALL).filter("conv_id = 1").agg(F.sum("tokens")).first()[0]
    assert total == row.after_tokens


# --- sessions ------------------------------------------------------------------------------------------

LOG = "session long, seq long, type string, role string, text string, op string, start long, end long"


def test_fold(spark):
    rows = [(1, k, "m", "user", f"t{k}", "append", None, None) for k in range(5)] + [(1, 5, "m", "user", "new", "replace", 1, 3), (1, 6, "m", "user", "one", "replace", 4, 99), (1, 7, "m", "user", "late", "replace", 77, 78), (1, 8, "m", "assistant", "", "append", None, None)]
    got = Z.fold(spark.createDataFrame(rows, LOG)).orderBy("place").collect()
    assert [r.text for r in got] == ["t0", "new", "one", "late"] and [r.place for r in got] == [0, 1, 2, 3]


def test_pairs_orphans_and_logs(spark, tmp_path):
    calls = spark.createDataFrame([(1, "a", 1), (1, "a", 5), (1, "b", 9), (2, "a", 1)], "conv_id long, call_id string, seq long")
    results = spark.createDataFrame([(1, "a", 3), (1, "a", 4), (1, "b", 2), (1, "z", 7), (2, "a", 0)], "conv_id long, call_id string, seq long")
    assert sorted(map(tuple, Z.tool_pairs(calls, results).collect()), key=str) == sorted([(1, "a", 1, 3), (1, "a", 5, None), (1, "b", 9, None), (2, "a", 1, None)], key=str)
    assert [r.call_id for r in Z.orphan_results(results, calls).collect()] == ["z"]
    (tmp_path / "log.jsonl").write_text('{"seq": 1, "type": "x", "op": "append"}\nbroken{\n{"seq": 2, "type": "y"}\n{"seq": 9}\n')
    assert [r.seq for r in Z.read_log(spark, str(tmp_path / "log.jsonl"), 5).orderBy("seq").collect()] == [1, 2]


def test_zstandard_frames(spark, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    pack = zstandard.ZstdCompressor().compress
    (tmp_path / "log.zst").write_bytes(pack(b"one\ntwo\n") + b"\x28\xb5\x2f\xfdjunk" + pack(b"three\n"))
    assert [r.line for r in Z.read_frames(spark, str(tmp_path / "log.zst")).collect()] == ["one", "two", "three"]


def test_stability():
    assert Z.common_prefix("abcd", "abxd") == 2 and Z.common_prefix("", "x") == 0 and Z.common_prefix("same", "same") == 4


def test_owner(spark):
    requests = spark.createDataFrame([(1, k, k) for k in range(20)] + [(2, 0, 900)], "request_id long, seq long, message_id long")
    events = spark.createDataFrame([("b", 1, 19), ("a", 1, 3), ("a", 2, 15)], "agent string, seq long, message_id long")
    assert {r.request_id: r.agent for r in Z.owner(requests, events).collect()} == {1: "a", 2: None}
    assert {r.request_id: r.agent for r in Z.owner(requests, events.filter("agent = 'b'")).collect()} == {1: "b", 2: "b"}
    assert MESSAGE.startswith("conv_id")
