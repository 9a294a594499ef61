from __future__ import annotations

import json
from collections import defaultdict

import duckdb
import pytest
from brevia.llm import chat_format as C
from pyspark.sql import functions as F

NAMES = ["conv_id", "turn", "kind", "call_id", "rank", "status", "error", "json"]


def test_query_equals_oracle(spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.sql(C.oracle()).limit(10**6).fetchall()
    found = C.op10_chat_format(spark, sf_dir).select(NAMES).collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert {r.status for r in found} == {"message", "linked", "unanswered", "cyclic", "duplicate", "orphan"} and len({r.error for r in found}) == 3
    assert sum(r.kind == "call" and r.rank > r.turn for r in found) > 20


@pytest.mark.parametrize(
    ("raw", "want"),
    [('{"b": 1.0, "a": [true, null, "é\\n\\u0001"]}', '{"a":[true,null,"é\\n\\u0001"],"b":1}'), ("1e21", "1e+21"), ("0.0000001", "1e-7"), ("123456789012345678901234567890", "123456789012345678901234567890"), ("2.50", "2.5"), ("-0.0", "0"), ("123456789012345680000.0", "123456789012345680000"), ("0.00001", "0.00001"), ("1.5e300", "1.5e+300"), ('"\\ud800x"', '"\\ud800x"')],
)
def test_canonical_json(raw, want):
    assert C.canonical(json.loads(raw)) == want


def test_schemas():
    read = lambda raw, name="search": C.read_arguments(name, raw, C.SCHEMAS)[1]
    assert read('{"query": "x", "limit": 2}') is None and read('{"query": "x", "limit": 2.0}') is None
    assert read('{"limit": 2}') == "query: missing" and read('{"query": 1, "limit": 2}') == "query: not of type string"
    assert read('{"query": "", "limit": true}') == "limit: not of type integer" and read('{"query": "", "limit": 1, "z": 1}') == "z: unknown"
    assert read("{") == read('{"a": NaN}') == "arguments: not JSON" and read("[1]") == read(None) == "arguments: not of type object"
    assert read('{"query": "a", "query": "b", "limit": 2}') == "arguments: repeated key" and read('{"\\ud800": 1, "query": "", "limit": 1}') == "\\ud800: unknown"
    assert C.read_arguments("search", '{"query": "\\ud800", "limit": 1}', C.SCHEMAS) == ('{"limit":1,"query":"\\ud800"}', None)
    assert read("{}", "what") == "unknown tool" and read("[" * 100_000) == "arguments: not JSON"
    deep = {"type": "object", "properties": {"a": {"type": "array", "items": {"enum": [1, 2]}}}}
    assert C.fault({"a": [1, 3]}, deep) == "a[1]: not in the enumeration"


CALLS = "conv_id long, turn long, call_id string, name string, arguments string"
RESULTS = "conv_id long, turn long, call_id string, text string"
MESSAGES = "conv_id long, turn long, role string, text string"


def args(*refs):
    return json.dumps({f"k{i}": f"$call:{r}" for i, r in enumerate(refs)})


def test_topological_order(spark):
    calls = [(1, 5, "a", "t", args("b")), (1, 1, "b", "t", args("c")), (1, 3, "c", "t", args()), (1, 0, "d", "t", args("a", "c", "gone")), (1, 2, "x", "t", args("y")), (1, 2, "y", "t", args("x")), (1, 2, "z", "t", args("x")), (2, 0, "a", "t", args("a"))]
    results = [(1, 6, "a", ""), (1, 2, "b", ""), (1, 9, "c", ""), (3, 0, "a", "")]
    found = C.link(spark.createDataFrame([], MESSAGES), spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), {}).collect()
    rank = {(r.conv_id, r.kind, r.call_id): r.rank for r in found}
    assert {k[1:]: v for k, v in rank.items() if k[0] == 1 and k[2] in "abcd"} == {
        ("call", "c"): 3, ("result", "c"): 9, ("call", "b"): 10, ("result", "b"): 11, ("call", "a"): 12, ("result", "a"): 13, ("call", "d"): 14,
    }
    status = defaultdict(set)
    for r in found:
        status[r.status].add((r.conv_id, r.kind, r.call_id))
    assert status["cyclic"] == {(1, "call", "x"), (1, "call", "y"), (1, "call", "z"), (2, "call", "a")}
    assert status["orphan"] == {(3, "result", "a")} and status["unanswered"] == {(1, "call", "d")}


def test_odd_tables(spark):
    messages = spark.createDataFrame([(1, 0, "user", None), (None, None, None, "x" * 100_000), (1, 0, "user", None)], MESSAGES).withColumn("rank", F.lit(1))
    calls = spark.createDataFrame([(1, 1, "a", "search", None), (1, 2, "a", "search", "{}"), (1, 1, "a", "search", None), (None, None, None, None, None)], CALLS).withColumn("status", F.lit(1))
    results = spark.createDataFrame([(1, 3, "a", None), (1, 4, "a", "late"), (1, 5, None, "")], RESULTS).withColumn("cyclic", F.lit(1))
    found = C.link(messages, calls, results, C.SCHEMAS).collect()
    assert len(found) == 10
    have = sorted((str(r.conv_id), r.kind, r.turn, r.status) for r in found if r.turn is not None and r.kind != "message")
    assert have == [("1", "call", 1, "linked"), ("1", "call", 1, "linked"), ("1", "call", 2, "duplicate"), ("1", "result", 3, "linked"), ("1", "result", 4, "duplicate"), ("1", "result", 5, "orphan")]
    assert {r.json for r in found if r.kind == "message"} == {'{"content":null,"role":"user"}', f'{{"content":"{"x" * 100_000}","role":null}}'}
    none = [x.filter(F.lit(False)) for x in (messages, calls, results)]
    assert C.link(*none, C.SCHEMAS).count() == 0


def brute_ranks(calls, results):
    """Rank by rank, all calls of a conversation at hand. calls: (conv, turn, id, refs)."""
    answered, first = {}, {}
    for conv, turn, who in sorted(results):
        answered.setdefault((conv, who), turn)
    for conv, turn, who, refs in sorted(calls):
        first.setdefault((conv, who), (turn, refs))
    rank, end = {}, {}
    while True:
        ready = [k for k, (_, refs) in first.items() if k not in rank and all((k[0], r) in end or (k[0], r) not in first for r in refs)]
        if not ready:
            return {k: rank.get(k, t) for k, (t, _) in first.items()}, first.keys() - rank.keys()
        for k in ready:
            rank[k] = max([first[k][0], *(end[k[0], r] + 1 for r in first[k][1] if (k[0], r) in end)])
        for k in ready:
            end[k] = max(answered[k], rank[k] + 1) if k in answered else rank[k]


def test_ranks_equal_brute_force(spark):
    """Long chains, forks, circles and several references; rounds grow with the logarithm of a chain."""
    import random

    draw, calls, results = random.Random(8), [], []
    for conv in range(12):
        n = draw.randint(1, 60)
        for k in range(n):
            wide = draw.choice([[], [k - 1], [k + 1], [draw.randint(0, n)], [draw.randint(0, n), draw.randint(0, k)]])
            refs = [k - 1] if conv < 3 and k else [] if conv < 3 else wide
            calls.append((conv, draw.randint(0, 30), f"c{k}", [f"c{r}" for r in refs if r != k or conv > 9]))
            if draw.random() < 0.5:
                results.append((conv, draw.randint(0, 40), f"c{k}"))
    frames = (spark.createDataFrame([(c, t, k, "t", args(*r)) for c, t, k, r in calls], CALLS), spark.createDataFrame([(*r, "x") for r in results], RESULTS))
    found = [r for r in C.link(spark.createDataFrame([], MESSAGES), *frames, {}).collect() if r.kind == "call"]
    rank, cyclic = brute_ranks(calls, results)
    assert {(r.conv_id, r.call_id): r.rank for r in found} == rank and {(r.conv_id, r.call_id) for r in found if r.status == "cyclic"} == cyclic and cyclic


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    cut = C.cut
    monkeypatch.setattr(C, "cut", lambda df, narrow=False: rounds.append(1) or cut(df, narrow))
    calls = spark.createDataFrame([(1, 0, f"c{k}", "t", args(f"c{k - 1}") if k else "{}") for k in range(500)], CALLS)
    found = {r.call_id: r.rank for r in C.link(spark.createDataFrame([], MESSAGES), calls, spark.createDataFrame([], RESULTS), {}).collect()}
    assert found == {f"c{k}": k for k in range(500)} and len(rounds) < 16


def test_ties_of_one_identifier(spark):
    calls = spark.createDataFrame([(1, 1, "a", "t", '{"k": 1}'), (1, 1, "a", "t", '{"k": 2}'), (1, 1, "b", "t", "{}"), (1, 1, "b", "t", "{}")], CALLS)
    results = spark.createDataFrame([(1, 2, "a", "x"), (1, 2, "a", "y")], RESULTS)
    found = C.link(spark.createDataFrame([], MESSAGES), calls, results, {}).collect()
    status = sorted((r.kind, r.call_id, r.status) for r in found)
    assert status == [("call", "a", "duplicate"), ("call", "a", "linked"), ("call", "b", "unanswered"), ("call", "b", "unanswered"), ("result", "a", "duplicate"), ("result", "a", "linked")]


def test_a_chain_of_calls_with_two_references_takes_few_rounds(spark, monkeypatch):
    """Each call waits for the two before it: as many rounds as calls would fill the driver with plans."""
    rounds, cut, n = [], C.cut, 700
    monkeypatch.setattr(C, "cut", lambda df, narrow=False: rounds.append(1) or (cut(df, narrow) if len(rounds) < 20 else pytest.fail("too many rounds")))
    calls = spark.createDataFrame([(4, 0, f"c{k}", "t", args(*(f"c{r}" for r in (k - 1, k - 2) if r >= 0))) for k in range(n)], CALLS)
    results = spark.createDataFrame([(4, 0, f"c{k}", "x") for k in range(0, n, 7)], RESULTS)
    found = {r.call_id: r.rank for r in C.link(spark.createDataFrame([], MESSAGES), calls, results, {}).collect() if r.kind == "call"}
    assert found == {f"c{k}": k + -(-k // 7) for k in range(n)}


@pytest.mark.parametrize("whole", [0, 3, 20])
def test_large_conversations_get_the_same_ranks(spark, monkeypatch, whole):
    import random

    monkeypatch.setattr(C, "WHOLE", whole)
    draw, calls, results = random.Random(9), [], []
    for conv in range(8):
        n = draw.choice([2, 3, 4, 30])
        for k in range(n):
            refs = draw.choice([[], [k - 1], [k - 1, k - 2], [draw.randint(0, n)], [k] if conv > 5 else []])
            calls.append((conv, draw.randint(0, 30), f"c{k}", [f"c{r}" for r in refs]))
            if draw.random() < 0.5:
                results.append((conv, draw.randint(0, 40), f"c{k}"))
    frames = (spark.createDataFrame([(c, t, k, "t", args(*r)) for c, t, k, r in calls], CALLS), spark.createDataFrame([(*r, "x") for r in results], RESULTS))
    found = [r for r in C.link(spark.createDataFrame([], MESSAGES), *frames, {}).collect() if r.kind == "call"]
    rank, cyclic = brute_ranks(calls, results)
    assert {(r.conv_id, r.call_id): r.rank for r in found} == rank and {(r.conv_id, r.call_id) for r in found if r.status == "cyclic"} == cyclic
