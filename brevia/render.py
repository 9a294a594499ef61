"""Tool results as text columns: what a person or a model reads of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevia.functions.markers import distill_block_column


def _table(rows: DataFrame, columns: list[tuple[str, Column]], order: str, empty: str) -> DataFrame:
    """(text): rows as a table with a heading, one line each; a catalogue has few rows."""
    cells = F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit("-")) for _, c in columns))
    head = " | ".join(n for n, _ in columns) + "\n" + " | ".join("---" for _ in columns)
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), cells.alias("line"))))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return rows.agg(F.when(F.count(F.lit(1)) == 0, empty).otherwise(F.concat(F.lit(f"{head}\n"), body)).alias("text"))


def _gigabytes(name: str) -> Column:
    return F.concat(F.col(name).cast("string"), F.lit(" GB"))


def installed_text(models: DataFrame) -> DataFrame:
    """The installed models of sources.models.catalogue()."""
    return _table(models, [("name", F.col("name")), ("parameters", F.col("parameter_size")), ("quant", F.col("quantization")), ("size", _gigabytes("size_gb")), ("modified", F.col("modified_at"))], "name", "no model is installed")


def running_text(models: DataFrame) -> DataFrame:
    return _table(models, [("name", F.col("name")), ("size", _gigabytes("size_gb")), ("in video memory", _gigabytes("vram_gb")), ("until", F.col("expires_at"))], "name", "no model is running")


def reply_text(prefix: str = "reply_") -> Column:
    """A reply of operators.run.chat_rows(): its thoughts, its text and a line of figures; or its error."""
    c = lambda name: F.col(f"{prefix}{name}")
    speed = F.when(c("tokens_per_second").isNotNull(), F.concat(c("tokens_per_second").cast("string"), F.lit(" tokens/s")))
    figures = F.concat_ws(", ", c("model"), F.concat(c("prompt_tokens").cast("string"), F.lit(" tokens read")), F.concat(c("completion_tokens").cast("string"), F.lit(" written")), F.concat(c("total_duration_ms").cast("string"), F.lit(" ms")), speed)
    thoughts = F.when(F.coalesce(c("thinking"), F.lit("")) != "", F.concat(F.lit("(thinking) "), c("thinking"), F.lit("\n\n")))
    said = F.concat(F.coalesce(thoughts, F.lit("")), F.coalesce(c("content"), F.lit("")), F.lit("\n\n["), figures, F.lit("]"))
    return F.when(c("error").isNotNull(), F.concat(F.lit("the call failed: "), c("error"))).otherwise(said)


def task_text() -> Column:
    """A row of operators.run.run_over_files(): the answer and how the files were fitted; or its error."""
    fitted = F.concat(F.lit("\n\n[files: "), "strategy", F.when(F.col("n_parts") > 1, F.concat(F.lit(" in "), F.col("n_parts").cast("string"), F.lit(" parts"))).otherwise(""), F.lit("]"))
    return F.when(F.col("error").isNotNull(), F.concat(F.lit("the task failed: "), F.col("error"))).otherwise(F.concat(F.coalesce("answer", F.lit("")), fitted))


def distilled_text() -> Column:
    """A row of operators.run.distill_any(): a shortened text as a marked block, so that it isn't distilled again."""
    skipped = F.concat(F.lit("not shortened ("), F.col("original_chars").cast("string"), F.lit(" characters)"))
    short = F.when(F.col("content").startswith("⟦"), F.col("content")).otherwise(distill_block_column(F.col("original_chars"), F.col("before_tokens"), F.col("after_tokens"), F.col("content")))
    return F.when(F.col("error").isNotNull(), F.concat(F.lit("distillation failed: "), F.col("error"))).when(F.col("skipped"), skipped).otherwise(short)


__all__ = ["distilled_text", "installed_text", "reply_text", "running_text", "task_text"]
