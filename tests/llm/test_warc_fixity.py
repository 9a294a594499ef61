from __future__ import annotations

import gzip
import hashlib
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import duckdb
import pytest
from brevia.llm import warc_fixity as W
from pyspark.sql import functions as F


def rows(df, names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_query_equals_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = con.sql(W.oracle()).limit(10**6).fetchall()
    names = ["page_id", "file", "offset", "length", "sha256", "other_offset", "other_length", "other_sha256", "status"]
    assert rows(W.op5_warc_fixity(spark, sf_dir), names) == sorted(want, key=str)


def test_files_and_records_agree(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").filter("page_id < 120")
    records = W.warc_records(pages, per_file=10)
    text = W.warc_text(F.col("page_id"), F.col("url"), F.col("html"))
    by_file = {}
    for r in pages.orderBy("page_id").select("page_id", "html", text.alias("t")).collect():
        by_file.setdefault(f"part-{r.page_id // 10}.warc", b"")
        by_file[f"part-{r.page_id // 10}.warc"] += r.t.encode()
    for name, content in by_file.items():
        (tmp_path / name).write_bytes(content)
    found = W.read_warc(spark, str(tmp_path))
    names = ["file", "record_id", "offset", "length", "sha256"]
    assert rows(found, names) == rows(records, names)
    assert {r.record_id: r.payload.decode() for r in found.collect()} == {r.page_id: r.html for r in pages.collect()}
    assert W.root(found) == W.root(records)
    broken = bytearray(by_file["part-1.warc"])
    broken[len(broken) // 2] ^= 1
    (tmp_path / "part-1.warc").write_bytes(bytes(broken))
    differing = W.audit(records, W.read_warc(spark, str(tmp_path))).collect()
    assert W.root(W.read_warc(spark, str(tmp_path))) != W.root(records) and differing and {r.file for r in differing} == {"part-1.warc"}


def warc(k, payload):
    return f"WARC/1.1\r\nWARC-Record-ID: <urn:page:{k}>\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def test_the_parser_reads_on_after_damage():
    assert list(W.parse_warc(b"")) == [] and [x[:3] for x in W.parse_warc(b"junk")] == [(0, 4, b"")]
    records = [warc(k, b"page WARC/1.1 %d" % k * (k + 1)) for k in range(6)]
    whole, at = b"".join(records), [sum(map(len, records[:k])) for k in range(7)]
    assert [x[0] for x in W.parse_warc(whole)] == at[:-1] and [x[0] for x in W.parse_warc(whole[:-4])] == at[:-1]
    for k in range(6):
        for damage in (b"XARC", b"WARC/1.1\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 8"):  # no record; another length
            broken = whole[: at[k]] + damage + whole[at[k] + len(damage) :]
            found = list(W.parse_warc(broken))
            assert [x[:2] for x in found] == [(at[j], len(records[j])) for j in range(6)] and [bool(x[2]) for x in found] == [j != k for j in range(6)]
    cut_off = list(W.parse_warc(whole[: at[5] + 10]))
    assert [bool(x[2]) for x in cut_off] == [True] * 5 + [False]


def test_gzipped_files(spark, tmp_path):
    records = [warc(k, b"some text that repeats " * (200 * k + 1)) for k in range(5)]
    members = [gzip.compress(r) for r in records]
    at = [sum(map(len, members[:k])) for k in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "b").mkdir()
    broken = bytearray(b"".join(members))
    broken[at[2] + 15] ^= 255
    (tmp_path / "b" / "a.warc.gz").write_bytes(bytes(broken))
    first, second = W.read_warc(spark, str(tmp_path / "a.warc.gz")), W.read_warc(spark, str(tmp_path / "b"))
    assert [(r.record_id, r.offset, r.length) for r in first.orderBy("offset").collect()] == [(k, at[k], len(members[k])) for k in range(5)]
    assert [r.payload for r in first.orderBy("offset").collect()] == [x.split(b"\r\n\r\n")[1] for x in records]
    assert sorted((r.record_id, r.status) for r in W.audit(first, second).collect()) == [(-1, "extra"), (2, "missing")]
    both = gzip.compress(records[0] + records[1])
    assert [x[:2] for x in W.parse_warc(both + members[2])] == [(0, len(both)), (0, len(both)), (len(both), len(members[2]))]
    assert [bool(x[2]) for x in W.parse_warc(both[:-20] + members[2])] in ([False, True], [False])


SCHEMA = "file string, record_id long, offset long, length long, sha256 string"


def replica(spark, items):
    return spark.createDataFrame([(f, k, o, n, hashlib.sha256(x.encode()).hexdigest()) for f, k, o, n, x in items], SCHEMA)


@pytest.mark.parametrize("n", [5, 300])
def test_audit_equals_brute_force(spark, n):
    base = [(f"f{k % 3}", k, 10 * k, 10, f"x{k}") for k in range(n)]
    other = [(f, k, o, n, x if k % 29 != 3 else "bad") for f, k, o, n, x in base if k % 37 != 4]
    other = [(f, k, o + (5 if k > n - 4 else 0), s, x) for f, k, o, s, x in other] + [("f9", 1000, 0, 5, "new")]
    found = {(r.file, r.record_id): r.status for r in W.audit(replica(spark, base), replica(spark, other)).collect()}
    a, b = ({(f, k): (o, x) for f, k, o, _, x in side} for side in (base, other))
    want = {}
    for key in a.keys() | b.keys():
        if key not in b or key not in a:
            want[key] = "missing" if key in a else "extra"
        elif a[key] != b[key]:
            want[key] = "corrupt" if a[key][1] != b[key][1] else "moved"
    assert found == want


def test_odd_tables(spark):
    base = replica(spark, [("f", 1, 0, 10, "x")] * 3 + [("f", 2, 10, 5, "y")])
    empty = base.filter(F.lit(False))
    assert W.audit(base, base).count() == 0 and W.root(base) == W.root(base) and W.root(empty) is None
    assert [r.status for r in W.audit(base, empty).collect()] == ["missing"] * 4
    assert [r.status for r in W.audit(empty, base).collect()] == ["extra"] * 4 and W.audit(empty, empty).count() == 0
    assert W.audit(base, base.filter("record_id = 1")).select("status").collect()[0].status == "missing"
    pages = spark.createDataFrame([(None, None, None, 1), (3, "u", "", 2), (3, "u", "", 2), (-5, "v", "é", 0)], "page_id long, url string, html string, offset int")
    found = W.warc_records(pages)
    assert found.count() == 4 and W.audit_all(found, found).filter("status != 'intact'").count() == 0


def test_files_follow_rows_and_cores(spark):
    """Many shuffle partitions of few rows don't make many files, and the audit stays whole."""
    base = replica(spark, [(f"f{k % 40}", k, 10 * k, 10, f"x{k}") for k in range(800)])
    other = base.filter("record_id % 37 != 4").withColumn("sha256", F.when(F.expr("record_id % 29 = 3"), F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    few, place = max(4, spark.sparkContext.defaultParallelism), Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    seen = set(place.rglob("part-*"))
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        found = W.audit_all(base, other)
        assert found.rdd.getNumPartitions() <= few
        status = {r.record_id: r.status for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    written = set(place.rglob("part-*")) - seen
    assert status == {k: "missing" if k % 37 == 4 else "corrupt" if k % 29 == 3 else "intact" for k in range(800)}
    by_table = Counter(p.parent for p in written)
    assert len(by_table) >= 3 and max(by_table.values()) <= few
