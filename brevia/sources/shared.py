"""Results that several queries read, kept where all executors see them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df, computed once into spark.checkpoint.dir, so that a lost executor costs nothing. Where that is unset, a folder
    of our own in local mode (tests), else an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
            found = tempfile.mkdtemp(prefix="brevia-")
        context.setCheckpointDir(found)
    return df.checkpoint()
