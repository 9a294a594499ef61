"""Files as rows, and blocks of several files for a model's context."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.functions.text import u16_left, u16_len

MAX_UNITS = 20_000
PREAMBLE = "These are the contents of the files to work on:\n\n"


def normalise_paths(paths: Column) -> Column:
    """Trimmed paths of an array, blank and null ones left out; null gives none."""
    trimmed = F.transform(F.coalesce(paths, F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"(?U)^[\s﻿]+|[\s﻿]+$", ""))
    return F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(pos, path, content, error) in the order given by pos: a file that can't be read is a row with an error, not a
    failed job.

    Paths are read where the task runs; for stores that only Spark reads use spark.read.text(wholetext=True).
    """

    def run(batches):
        for batch in batches:
            read = [_read(path) for path in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[k] for x in read], pa.string()) for k in (0, 1))], ["pos", "path", "content", "error"])

    rows = list(enumerate(p.strip() for p in paths if isinstance(p, str) and p.strip()))
    return spark.createDataFrame(rows, "pos int, path string").mapInArrow(run, "pos int, path string, content string, error string")


def _read(path: str) -> tuple[str | None, str | None]:
    try:
        with open(path, encoding="utf-8", newline="") as file:
            return file.read(), None
    except (OSError, ValueError) as error:
        return None, f"cannot read {path}: {error}"


def text_or_path(rows: DataFrame, text: str = "text", path: str = "path", out: str = "source") -> DataFrame:
    """rows with out and out_error: the text, unless it is null or empty, else the content of the file at path."""

    @F.arrow_udf("struct<content:string,error:string>")
    def load(paths: pa.Array) -> pa.Array:
        read = [_read(p) if p else (None, "no text and no path") for p in paths.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[k] for x in read], pa.string()) for k in (0, 1)], ["content", "error"])

    given = F.coalesce(F.col(text) != "", F.lit(False))
    has = rows.filter(given).withColumn(out, F.col(text)).withColumn(f"{out}_error", F.lit(None).cast("string"))
    not_given = rows.filter(~given).withColumn("__brevia_file", load(F.col(path)))  # only these files are read
    return has.union(not_given.withColumn(out, F.col("__brevia_file.content")).withColumn(f"{out}_error", F.col("__brevia_file.error")).drop("__brevia_file"))


def capped(content: Column, most: int = MAX_UNITS) -> Column:
    """The content's beginning, with a note of how much is left out; no character is cut in two."""
    extra = u16_len(content) - most
    note = F.concat(F.lit("\n… [shortened, "), extra.cast("string"), F.lit(" characters left out] …"))
    return F.when(extra > 0, F.concat(u16_left(content, most), note)).otherwise(content)


def files_block(files: DataFrame, group: list[str], path: str = "path", content: str = "content", order: str = "pos") -> DataFrame:
    """(group..., n_files, block): the files of each group, numbered in order, each under a heading. order: the column
    that holds the place of a file in its list."""
    text = F.coalesce(capped(F.col(content)), F.lit("[not readable]"))
    part = F.struct(F.col(order).alias("o"), F.col(path).alias("p"), text.alias("t"))
    listed = files.groupBy(*group).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    n = F.size("parts")
    heads = F.transform("parts", lambda x, k: F.concat(F.lit("===== FILE "), (k + 1).cast("string"), F.lit("/"), n.cast("string"), F.lit(": "), x["p"], F.lit(" =====\n"), x["t"]))
    return listed.select(*group, n.alias("n_files"), F.concat(F.lit(PREAMBLE), F.array_join(heads, "\n\n")).alias("block"))
