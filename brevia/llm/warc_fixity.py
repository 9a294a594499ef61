"""WARC fixity: Merkle trees over records, compared from the root down.

A replica is a table of records (file, record_id, offset, length, sha256): what read_warc() finds in
stored files, or what warc_records() would write for a table of pages. Inside a file, records are
ordered by offset; each is a leaf that hashes its offset, length and content hash, and every FANOUT
neighbours make a node that hashes their offset range and their hashes. File roots hang in a trie over
the md5 of the file's name, two hex digits a level, so the tree above them has a fixed height and no
group holds many files. A tree is a table of (level, node, parent, hash), a fifteenth of the size of
its records; the trees of two replicas are built side by side in one table.

Two replicas are compared level by level: nodes whose hashes differ, or that one side lacks, are the
next level's parents, and only their children are compared; the parents are broadcast up to
MAX_BROADCAST and joined beyond. Equal roots end the audit at once. The records below mismatching
leaves are matched by file and record id and called

  corrupt  the contents differ        moved  equal contents at another offset
  missing  only in the first replica  extra  only in the second

A damaged range of a stored file counts as a record of its own, and the records after it are read on. Records of
one file and id are matched in order of offset. Null and empty fields count as empty.
Empty replicas have no root; against one, every record is missing or extra. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brevia.llm.shared import cut, tables

FANOUT = 16
#: Lengths of the md5 prefixes of the trie's levels, from the root.
TRIE = (0, 2, 4)
MAX_BROADCAST = 100_000
FILE_RECORDS = 1000
#: So many shuffle partitions of records share a file, unless cores would idle: a record's row holds hashes, no content.
FILE_PARTITIONS = 16
PIECE = 1 << 16
DATE = "1970-01-01T00:00:00Z"


def warc_text(record_id: Column, url: Column, payload: Column) -> Column:
    """A WARC/1.1 resource record, as text."""
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), record_id.cast("string"), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, payload, F.lit("\r\n\r\n"))


def warc_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", per_file: int = FILE_RECORDS) -> DataFrame:
    """The records of pages in files of per_file keys each, in order of key.

    The window that adds up lengths sees hashes, not pages, and one file's records at a time.
    """
    number = F.coalesce(F.col(key).cast("long"), F.lit(-1))
    text = warc_text(number, F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col(html), F.lit("")))
    file = F.concat(F.lit("part-"), F.floor(number / per_file).cast("string"), F.lit(".warc"))
    hashed = pages.select(file.alias("file"), number.alias("record_id"), F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("sha256"))
    before = Window.partitionBy("file").orderBy("record_id", "sha256").rowsBetween(Window.unboundedPreceding, -1)
    return hashed.select("file", "record_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "sha256")


GZIP = b"\x1f\x8b\x08"


def _record(content: bytes, at: int) -> tuple[int, int, int] | None:
    """(end of the header, end of the payload, end) of the record at a place, or None: it must be followed by blank
    lines, which the last one may lack."""
    if not content.startswith(b"WARC/", at):
        return None
    head = content.find(b"\r\n\r\n", at)
    size = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", content[at:head]) if head >= 0 else None
    if size is None:
        return None
    stop = head + 4 + int(size[1])
    if stop == len(content):
        return head, stop, stop
    return (head, stop, stop + 4) if content.startswith(b"\r\n\r\n", stop) else None


def _resume(content: bytes, at: int) -> int:
    """Where the next record after a damaged one begins, or the end."""
    while (at := content.find(b"WARC/", at + 1)) >= 0:
        if _record(content, at):
            return at
    return len(content)


def _member(content: bytes, at: int) -> tuple[bytes, int] | None:
    """The content and end of the gzip member at a place, or None."""
    reader, parts, k = zlib.decompressobj(31), [], at
    try:
        while not reader.eof:
            if k >= len(content):
                return None
            parts.append(reader.decompress(content[k : k + PIECE]))
            k += PIECE
    except zlib.error:
        return None
    return b"".join(parts), min(k, len(content)) - len(reader.unused_data)


def _members(content: bytes):
    """(offset, length, content or None) of a file's gzip members; None where there is a damaged range."""
    at = 0
    while at < len(content):
        if (found := _member(content, at)) is not None:
            yield at, found[1] - at, found[0]
            at = found[1]
            continue
        end = at
        while (end := content.find(GZIP, end + 1)) >= 0 and _member(content, end) is None:
            pass
        end = len(content) if end < 0 else end
        yield at, end - at, None
        at = end


def parse_warc(content: bytes):
    """Yields (offset, length, header, payload) of the records of a WARC file, in order. A range that holds no readable
    record comes as one with an empty header, and the records after it follow. Of a gzipped file, offset and
    length are those of the member in the file; a member of several records gives them all the same."""
    if content.startswith(GZIP):
        for at, size, whole in _members(content):
            if whole is None:
                yield at, size, b"", content[at : at + size]
            else:
                for _, _, head, payload in parse_warc(whole):
                    yield at, size, head, payload
        return
    at = 0
    while at < len(content):
        if found := _record(content, at):
            head, stop, end = found
            yield at, end - at, content[at:head], content[head + 4 : stop]
        else:
            end = _resume(content, at)
            yield at, end - at, b"", content[at:end]
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, record_id, offset, length, sha256, url, payload) of all records of the WARC files under path, gzipped or
    not. The record id is the number that ends the record's URN, or -1, as for damaged ranges. sha256 is of the
    record as stored, in gzipped files of header and payload. A file is read whole by one task (2 GB at most)."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                zipped = content.startswith(GZIP)
                for at, size, head, payload in parse_warc(content):
                    number = re.search(rb"(?im)^warc-record-id:.*?(\d+)>?\s*$", head)
                    url = re.search(rb"(?im)^warc-target-uri:\s*(\S*)", head)
                    stored = head + b"\r\n\r\n" + payload if zipped and head else content[at : at + size]
                    row = [name.rsplit("/", 1)[-1], int(number[1]) if number else -1, at, size, hashlib.sha256(stored).hexdigest(), url[1].decode(errors="replace") if url else "", payload]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["file", "record_id", "offset", "length", "sha256", "url", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, record_id long, offset long, length long, sha256 string, url string, payload binary")


# --- trees ----------------------------------------------------------------------------------------


def _leaves(*replicas: DataFrame) -> DataFrame:
    """Records with side (0 or 1), seq: their place in the file, and copy: their place among those of their id.
    One exchange by file serves both windows."""
    records = None
    for side, replica in enumerate(replicas):
        placed = replica.select(F.lit(side).alias("side"), "file", "record_id", "offset", "length", "sha256")
        records = placed if records is None else records.union(placed)
    in_file = Window.partitionBy("side", "file").orderBy("offset", "record_id", "sha256")
    same = Window.partitionBy("side", "file", "record_id").orderBy("offset", "sha256")
    hashed = F.sha2(F.concat_ws(":", F.lit("record"), "offset", "length", "sha256"), 256)
    return records.repartition("side", "file").withColumn("seq", F.row_number().over(in_file) - 1).withColumn("copy", F.row_number().over(same)).withColumn("hash", hashed)


def _joined(hashes: str, order: str) -> Column:
    """The hashes of a group, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(hashes).alias("h")))), lambda x: x["h"]), "")


def tree(leaves: DataFrame, depth: int) -> DataFrame:
    """(side, level, node, parent, hash) of all nodes. Level 0 is the root, the trie's others follow, then the
    files, then depth - 1 levels of groups of records, down to FANOUT.

    The groups of a file stay where the file is, so all levels below files take one exchange."""
    levels, files = [], len(TRIE)
    rows = leaves.select("side", "file", F.col("seq").alias("n"), "offset", (F.col("offset") + F.col("length")).alias("end"), "hash").repartition("side", "file")
    for k in range(depth, 0, -1):
        rows = rows.groupBy("side", "file", F.expr(f"n div {FANOUT}").alias("n")).agg(
            F.min("offset").alias("offset"), F.max("end").alias("end"), _joined("hash", "n").alias("below")
        ).select("side", "file", "n", "offset", "end", F.sha2(F.concat_ws(":", F.lit("range"), "offset", "end", "below"), 256).alias("hash"))
        node = F.concat_ws("/", "file", "n") if k > 1 else F.col("file")
        parent = F.concat_ws("/", "file", F.expr(f"n div {FANOUT}")) if k > 2 else F.col("file") if k == 2 else F.substring(F.md5("file"), 1, TRIE[-1])
        levels.append(rows.select("side", F.lit(files + k - 1).alias("level"), node.alias("node"), parent.alias("parent"), "hash"))
    above = rows.select("side", F.substring(F.md5("file"), 1, TRIE[-1]).alias("node"), F.col("file").alias("child"), "hash")
    for k in range(files - 1, -1, -1):
        nodes = above.groupBy("side", "node").agg(F.sha2(F.concat(F.lit("names:"), _joined("hash", "child")), 256).alias("hash"))
        higher = F.substring("node", 1, TRIE[k - 1]) if k else F.lit(None).cast("string")
        levels.append(nodes.select("side", F.lit(k).alias("level"), "node", higher.alias("parent"), "hash"))
        above = nodes.select("side", higher.alias("node"), F.col("node").alias("child"), "hash")
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


def _packed(df: DataFrame) -> DataFrame:
    """Rows for each record, in a file for FILE_PARTITIONS shuffle partitions, but for one for each core at least.
    Hadoop's local file system starts processes for each file that it writes, however few rows that has."""
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // FILE_PARTITIONS))


def root(records: DataFrame) -> str | None:
    """The replica's root hash; replicas of equal records in equal places have equal roots."""
    leaves = cut(_packed(_leaves(records)))
    found = tree(leaves, _depth(leaves)).filter("level = 0").first()
    return found.hash if found else None


def _depth(leaves: DataFrame) -> int:
    most, depth = leaves.agg(F.max("seq")).first()[0] or 0, 1
    while most >= FANOUT**depth:
        depth += 1
    return depth


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MAX_BROADCAST else df


def _of_side(side: int, name: str) -> Column:
    return F.max(F.when(F.col("side") == side, F.col(name)))


def audit_all(first: DataFrame, second: DataFrame) -> DataFrame:
    """(file, record_id, copy, offset, length, sha256, other_offset, other_length, other_sha256, status) of every
    record of two replicas; status is intact where they agree."""
    leaves = cut(_packed(_leaves(first, second)))
    depth = _depth(leaves)
    nodes = cut(tree(leaves, depth), True)
    differ, n = None, 1
    for level in range(len(TRIE) + depth):
        here = nodes.filter(F.col("level") == level)
        if differ is not None:
            here = here.join(_small(differ, n), F.col("parent") == F.col("wanted"), "left_semi")
        both = here.groupBy("node").agg(_of_side(0, "hash").alias("a"), _of_side(1, "hash").alias("b"))
        found = both.filter(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("node").alias("wanted"))
        differ = cut(found.coalesce(1)) if level < len(TRIE) else cut(found, True)  # the trie has 16 ** TRIE[-1] nodes a level at most
        n = differ.count()
        if not n:
            break
    group = F.concat_ws("/", "file", F.expr(f"seq div {FANOUT}")) if depth > 1 else F.col("file")
    keys, names = ["file", "record_id", "copy"], ["offset", "length", "sha256"]
    grouped = leaves.withColumn("__group", group)
    below = grouped.join(_small(differ, n), F.col("__group") == F.col("wanted"), "left_semi")
    paired = below.groupBy(*keys).agg(*(_of_side(0, c).alias(c) for c in names), *(_of_side(1, c).alias(f"other_{c}") for c in names))
    status = (
        F.when(F.col("other_sha256").isNull(), "missing")
        .when(F.col("sha256").isNull(), "extra")
        .when(F.col("sha256") != F.col("other_sha256"), "corrupt")
        .when(F.col("offset") != F.col("other_offset"), "moved")
        .otherwise("intact")
    )
    elsewhere = grouped.filter("side = 0").join(_small(differ, n), F.col("__group") == F.col("wanted"), "left_anti")
    agreed = elsewhere.select(*keys, *names, *(F.col(c).alias(f"other_{c}") for c in names), F.lit("intact").alias("status"))
    return _packed(paired.withColumn("status", status).select(agreed.columns).union(agreed))


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of audit_all() in which the replicas differ."""
    return audit_all(first, second).filter("status <> 'intact'")


#: The faults of the second replica in op5: pages by the first two hex digits of md5(page_id).
ALTERED = ("00", "01", "02", "03")
SHORTENED = ("10", "11")
LOST = ("20",)


def damaged(pages: DataFrame) -> DataFrame:
    """A copy of pages with planted faults, as the test tables hold one replica only."""
    mark = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    html = F.when(mark.isin(*ALTERED), F.concat(F.lit("?"), F.expr("substring(html, 2)"))).when(mark.isin(*SHORTENED), F.expr("left(html, length(html) div 2)")).otherwise(F.col("html"))
    return pages.filter(~F.coalesce(mark, F.lit("")).isin(*LOST)).select("page_id", "url", html.alias("html"))


def op5_warc_fixity(spark, sf_dir: str) -> DataFrame:
    pages = tables(spark, sf_dir, "pages")
    found = audit_all(warc_records(pages), warc_records(damaged(pages)))
    return found.select(F.col("record_id").alias("page_id"), "file", "offset", "length", "sha256", "other_offset", "other_length", "other_sha256", "status")


def oracle() -> str:
    def records(source: str) -> str:
        return f"""SELECT file, record_id, length, sha256, coalesce(sum(length) OVER (PARTITION BY file ORDER BY record_id, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM (
            SELECT 'part-' || floor(page_id / {FILE_RECORDS}.0)::BIGINT || '.warc' AS file, page_id AS record_id, strlen(record)::BIGINT AS length, sha256(record) AS sha256 FROM (
            SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
                || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
                || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM {source}))"""

    lists = {name: ", ".join(f"'{x}'" for x in values) for name, values in (("altered", ALTERED), ("shortened", SHORTENED), ("lost", LOST))}
    return f"""WITH copied AS (SELECT page_id, url, CASE WHEN mark IN ({lists["altered"]}) THEN '?' || substring(html, 2)
            WHEN mark IN ({lists["shortened"]}) THEN left(html, length(html) // 2) ELSE html END AS html
        FROM (SELECT *, substring(md5(page_id::VARCHAR), 1, 2) AS mark FROM pages) WHERE mark NOT IN ({lists["lost"]})),
    a AS ({records("pages")}), b AS ({records("copied")})
    SELECT coalesce(a.record_id, b.record_id) AS page_id, coalesce(a.file, b.file) AS file, a."offset", a.length, a.sha256, b."offset" AS other_offset, b.length AS other_length, b.sha256 AS other_sha256,
        CASE WHEN b.sha256 IS NULL THEN 'missing' WHEN a.sha256 IS NULL THEN 'extra' WHEN a.sha256 <> b.sha256 THEN 'corrupt' WHEN a."offset" <> b."offset" THEN 'moved' ELSE 'intact' END AS status
    FROM a FULL JOIN b ON a.file = b.file AND a.record_id = b.record_id"""
