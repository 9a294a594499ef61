"""What the operators share: the folder all executors see, and Arrow plumbing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is frequent if it has more than one in so many of the rows, and more than so many rows.
HOT_KEYS, HOT_ROWS = 1000, 10_000
#: Bits of the map that near_keys() sends to all tasks, 2 MB.
MAP_BITS = 1 << 24


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of our own in local mode (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        found = context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = tempfile.mkdtemp(prefix="brevia-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/brevia/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of table_path() that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a DataFrame that is made inside go when an action on it ends, and don't wait until the
    driver happens to collect its garbage. For DataFrames of one action."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame, narrow: bool = False) -> DataFrame:
    """df, computed once and kept in the shared folder, until df is garbage if the session has
    spark.cleaner.referenceTracking.cleanCheckpoints on, else until the folder is cleared. narrow: rows of a few
    numbers, written as one file for each core and not one for each shuffle partition."""
    shared_dir(df.sparkSession)
    with released(df.sparkSession):
        return (df.coalesce(max(2, df.sparkSession.sparkContext.defaultParallelism)) if narrow else df.select("*")).checkpoint()


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, computed once and kept in the shared folder as Parquet, and its path for remove()."""
    path = table_path(df.sparkSession, name)
    with released(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def probable(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key, a hash, is in wanted (one long column, no nulls), and few others: for a join that follows,
    which then shuffles little more than it needs. What the driver and each task get is bounded by MAP_BITS."""
    place = F.pmod(F.col(wanted.columns[0]), F.lit(MAP_BITS)) + 1  # Spark numbers bitmaps of 4096 bytes from 1
    with released(rows.sparkSession):
        found = wanted.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).select("k", "bits")
    table = found.toArrow()
    flags = np.zeros((-(-MAP_BITS // 32768), 4096), np.uint8)
    for k, bits in zip(table["k"].to_pylist(), table["bits"].to_pylist(), strict=True):
        flags[k - 1] = np.frombuffer(bits, np.uint8)
    flags = flags.ravel()

    @F.arrow_udf("boolean")
    def there(keys: pa.Array) -> pa.Array:
        at = keys.to_numpy(zero_copy_only=False) % MAP_BITS
        return pa.array((flags[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return rows.filter(there(key))


def spread_join(rows: DataFrame, table: DataFrame, key: str, total: int, largest: int) -> DataFrame:
    """rows (total of them, at most largest with one key) joined on key with table, which has one row for each key,
    none null, and n: how many of rows have it. Keys with more than a HOT_KEYS-th of the rows, of which there are
    fewer than HOT_KEYS, are broadcast, so no task gets all rows of a frequent key. n is left out."""
    most = max(total // HOT_KEYS, HOT_ROWS)
    if largest <= most:
        return rows.join(table.drop("n"), key)
    hot = table.filter(F.col("n") > most).drop("n")
    cold = table.filter(F.col("n") <= most).drop("n")
    return rows.join(F.broadcast(hot), key).union(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def map_arrow(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """mapInArrow with one function per task, so that it can hold caches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if (out := step(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
