from __future__ import annotations

import random
from datetime import date, timedelta

import duckdb
import pytest
from brevia.llm import url_filter as V
from pyspark.sql import functions as F

NAMES = ["page_id", "url", "fetched", "host", "verdict", "category", "matched", "n_active"]


def test_query_equals_oracle(spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = con.sql(V.oracle()).limit(10**6).fetchall()
    found = V.op4_url_filter(spark, sf_dir).select(NAMES)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert {r.verdict for r in found.collect()} == {"none", "block", "allow"}


def brute(url, day, events):
    """Replays the list up to the day."""
    state = {}
    for key, when, action, verdict, category in sorted(events, key=lambda e: (e[1], e[2])):
        if when <= day.isoformat():
            if action == "add":
                state[key, category] = verdict
            else:
                state.pop((key, category), None)
    rest = url.split("://", 1)[1]
    host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower()
    path = "/".join(x for x in rest[len(rest.split("/")[0]) :].split("?")[0].split("#")[0].split("/") if x)
    active = [(-len(k), v, c, k) for (k, c), v in state.items() if (f"{host}/{path}/".startswith(f"{k}/") if "/" in k else host == k or host.endswith(f".{k}"))]
    return (*(min(active)[1:] if active else ("none", None, None)), len(active))


@pytest.mark.parametrize(("bound", "rows"), [(V.MAX_BROADCAST, V.KEY_ROWS), (0, V.KEY_ROWS), (3, 20)])
def test_as_of_join_equals_replay(spark, monkeypatch, bound, rows):
    monkeypatch.setattr(V, "MAX_BROADCAST", bound)
    monkeypatch.setattr(V, "KEY_ROWS", rows)
    draw = random.Random(bound)
    keys = ["a.com", "b.a.com", "a.com/x", "b.a.com/x/y", "c.org", "org"]
    start = date(2024, 1, 1)
    events = [(draw.choice(keys), (start + timedelta(draw.randint(0, 20))).isoformat(), action, "block" if c == "p" else "allow", c) for action in ("add", "remove") for c in "pq" for _ in range(12)]
    events = list({(k, d, c): (k, d, a, v, c) for k, d, a, v, c in events}.values())
    urls = ["http://a.com", "https://B.A.com/x/y?q", "http://u@b.a.com:80/x#f", "http://xa.com/x", "ftp://c.org/x//y/", "http://d.b.a.com/x/yy", "http://org"]
    rows = [(k, draw.choice(urls), start + timedelta(draw.randint(-2, 25))) for k in range(300)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date")
    found = V.judge(captures, spark.createDataFrame(events, V.EVENT_SCHEMA))
    have = {r.page_id: (r.verdict, r.category, r.matched, r.n_active) for r in found.collect()}
    assert have == {k: brute(u, d, events) for k, u, d in rows}


def test_odd_tables(spark):
    rows = [(1, None, date(2024, 7, 1), "x"), (2, "no url", date(2024, 7, 1), "x"), (None, "http://c.org/" + "s/" * 3000, None, "x"), (3, "http://c.org", date(2024, 7, 1), "x"), (3, "http://c.org", date(2024, 7, 1), "x")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date, key string")
    events = spark.createDataFrame([("C.org", "2024-01-01", "add", "block", "z"), (None, None, None, None, None)], V.EVENT_SCHEMA)
    found = V.judge(captures, events).collect()
    assert sorted((str(r.page_id), r.verdict) for r in found) == [("1", "none"), ("2", "none"), ("3", "block"), ("3", "block"), ("None", "none")]
    assert {r.verdict for r in V.judge(captures, events.filter(F.lit(False))).collect()} == {"none"}
    assert V.judge(captures.filter(F.lit(False)), events).count() == 0


def test_paths_keep_their_case(spark):
    events = spark.createDataFrame([("WWW.a.com/Ads", "2024-01-01", "add", "block", "x"), ("b.org/p/q/r/s", "2024-01-01", "add", "block", "deep")], V.EVENT_SCHEMA)
    urls = ["http://www.A.com/Ads/1", "http://www.a.com/ads/1", "http://b.org/p/q/r/s/t", "http://b.org/p/q/r"]
    captures = spark.createDataFrame([(k, u, date(2024, 7, 1)) for k, u in enumerate(urls)], "page_id long, url string, fetched date")
    found = {r.page_id: r.matched for r in V.judge(captures, events).collect()}
    assert found == {0: "www.a.com/Ads", 1: None, 2: "b.org/p/q/r/s", 3: None}
