"""Distillation caches as Parquet tables: loaded, added to, evicted and swapped in whole."""

from __future__ import annotations

import logging
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

log = logging.getLogger("brevia")
SCHEMA = "content_hash string, content string, inserted long"


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _pointed(spark: SparkSession, path: str) -> str | None:
    """The name of the current table, from the file that points to it."""
    pointer, fs = _filesystem(spark, f"{path}/CURRENT")
    if not fs.exists(pointer):
        return None
    line = spark.read.text(f"{path}/CURRENT").first()
    return line.value if line else None


def load(spark: SparkSession, path: str) -> DataFrame:
    """The cache at path, empty if there is none; one that can't be read is empty too, and said so in the log. Rows
    without a key are skipped."""
    found = None
    try:
        current = _pointed(spark, path)
        found = spark.read.parquet(f"{path}/{current}") if current else None
    except AnalysisException as error:
        log.warning("the cache at %s can't be read and counts as empty: %s", path, error)
    if found is None or not {"content_hash", "content", "inserted"} <= set(found.columns):
        return spark.createDataFrame([], SCHEMA)
    return found.select("content_hash", "content", F.col("inserted").cast("long")).filter("content_hash is not null")


def save(cache: DataFrame, path: str) -> None:
    """Writes a new table beside the old one, then renames a new pointer over the old, so that readers see the one or
    the other. The table before stays for readers that have begun; older ones go. One writer at a time."""
    spark, name = cache.sparkSession, f"v-{uuid.uuid4().hex}"
    before = _pointed(spark, path)
    cache.write.parquet(f"{path}/{name}")
    fresh, fs = _filesystem(spark, f"{path}/CURRENT-{name}")
    pointer, _ = _filesystem(spark, f"{path}/CURRENT")
    out = fs.create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    rename = getattr(hadoop, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fresh, pointer, options)
    folder, _ = _filesystem(spark, path)
    for status in fs.listStatus(folder):
        if status.getPath().getName().startswith("v-") and status.getPath().getName() not in (name, before):
            fs.delete(status.getPath(), True)


def merge(cache: DataFrame, fresh: DataFrame, limit: int) -> DataFrame:
    """First write wins; beyond limit entries the ones inserted first go."""
    added = fresh.join(cache, "content_hash", "left_anti").select(cache.columns)
    return evict_oldest(cache.union(added), limit)


def evict_oldest(entries: DataFrame, limit: int, key: str = "content_hash", order: str = "inserted") -> DataFrame:
    """The limit newest keys by first insertion. Inserting a key again doesn't make it newer.

    A top-k of limit rows: tasks keep their own newest, and only those meet."""
    first = entries.groupBy(key).agg(F.min(F.struct(F.col(order), *(F.col(c) for c in entries.columns if c not in (key, order)))).alias("e"))
    flat = first.select(key, "e.*").select(entries.columns)
    return flat.orderBy(F.col(order).desc(), F.col(key).desc()).limit(limit)


def evict_half(entries: DataFrame, limit: int, key: str = "content_hash", order: str = "inserted") -> DataFrame:
    """What is left of a cache of limit entries that, full, drops its older half before it takes the next one."""
    distinct = entries.groupBy(key).agg(F.min(order).alias(order))
    n = distinct.count()
    half = limit // 2
    left = n if n <= limit else limit - half + 1 + (n - limit - 1) % half
    return distinct.orderBy(F.col(order).desc(), F.col(key).desc()).limit(left)


def latest(entries: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The last rows of each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col(order).desc()))
    return entries.withColumn("__place", place).filter(F.col("__place") <= most).drop("__place")
