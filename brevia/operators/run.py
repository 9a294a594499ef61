"""File tasks: text is fitted to a model's window by strategy, then the instruction is run over it.

full: it fits. truncate: beginning and end. distill: shortened by the backend, then truncated if it is still
too long. chunk: the instruction runs over each piece as a row of its own, and once more over the joined
answers, so pieces of one file run in parallel on the cluster. Pieces fit what the task's instruction leaves of
the window. A task without content or instruction is a row with an error.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevia.config import EngineConfig
from brevia.functions.chunking import token_chunks_by, truncate_head_tail
from brevia.functions.text import estimate, estimate_tokens, savings_percent, u16_len
from brevia.operators.distill import distill, distill_text
from brevia.sources.backends import Backend, BackendError, chat

RESERVE = 180
PART_BREAK = "\n\n---\n\n"
# Instruction words that choose a strategy.
SUMMARY_WORDS = "摘要|总结|综述|概括|梗概|提炼|overview|summar|condense|digest"
ITEM_WORDS = "每个|each|逐条|批量|归类|分类|整理成表|翻译|提取\\s*所有|extract all|translate"


def auto_strategy(instruction: Column) -> Column:
    return F.when(instruction.rlike(f"(?i)({SUMMARY_WORDS})"), "distill").when(instruction.rlike(f"(?i)({ITEM_WORDS})"), "chunk").otherwise("truncate")


def with_format(instruction: Column, output_format: Column) -> Column:
    """The instruction, with the wished format of the answer if there is one."""
    wished = F.trim(output_format)
    return F.when(F.coalesce(wished, F.lit("")) != "", F.concat(F.trim(instruction), F.lit("\n\nGive the result in this format: "), wished, F.lit("."))).otherwise(F.trim(instruction))


def plan(tasks: DataFrame, config: EngineConfig, content: str = "content", instruction: str = "instruction", strategy: str | None = None) -> DataFrame:
    """tasks with content_tokens, room (for content), chunk_budget and strategy."""
    wished = F.lit("auto") if strategy is None else F.coalesce(F.col(strategy), F.lit("auto"))
    sized = tasks.withColumn("content_tokens", estimate_tokens(F.col(content))).withColumn("room", F.greatest(F.lit(1).cast("long"), F.lit(config.run_max_context_tokens) - estimate_tokens(F.col(instruction)) - RESERVE))
    chosen = F.when(F.col("content_tokens") <= F.col("room"), "full").when(wished == "auto", auto_strategy(F.col(instruction))).otherwise(wished)
    return sized.withColumn("chunk_budget", F.greatest(F.lit(500).cast("long"), F.floor(F.col("room") * 0.8))).withColumn("chosen", chosen).drop(*([strategy] if strategy else [])).withColumnRenamed("chosen", "strategy")


def _answers(rows: DataFrame, backend: Backend, config: EngineConfig, keys: list[str]) -> DataFrame:
    """(keys..., instruction, content, strategy, room) -> (keys..., answer, error)."""

    def run(batches):
        for batch in batches:
            columns = batch.to_pydict()
            answers, errors = [], []
            for instruction, content, strategy, room in zip(columns["instruction"], columns["content"], columns["strategy"], columns["room"], strict=True):
                try:
                    if strategy == "distill":
                        content = distill_text(content, backend, config)
                    if strategy in ("truncate", "distill"):
                        content = truncate_head_tail(content, room)[0]
                    answers.append(backend.complete(instruction, content, config))
                    errors.append(None)
                except BackendError as error:
                    answers.append(None)
                    errors.append(str(error))
            kept = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(answers, pa.string()), pa.array(errors, pa.string())], [*keys, "answer", "error"])

    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*dict.fromkeys([*keys, "instruction", "content", "strategy", "room"])).mapInArrow(run, f"{fields}, answer string, error string")


def run_over_files(tasks: DataFrame, backend: Backend, config: EngineConfig, key: str, strategy: str | None = None, output_format: str | None = None) -> DataFrame:
    """(key, strategy, n_parts, answer, error) of tasks (key, content, instruction[, strategy, output_format]).

    A file's error is that of its first part with one. Tasks with one key, content and instruction that are cut into
    pieces are one task; other tasks that share a key have a row each.
    """
    told = F.col("instruction") if output_format is None else with_format(F.col("instruction"), F.col(output_format))
    tasks = tasks.select(F.col(key), "content", told.alias("instruction"), *([F.col(strategy).alias("strategy")] if strategy else []))
    blank = F.col("content").isNull() | (F.trim(F.coalesce("instruction", F.lit(""))) == "")
    none = F.lit(None).cast("string")
    refused = tasks.filter(blank).select(key, none.alias("strategy"), F.lit(0).alias("n_parts"), none.alias("answer"), F.when(F.col("content").isNull(), "no content").otherwise("no instruction").alias("error"))
    planned = plan(tasks.filter(~blank), config, strategy="strategy" if strategy else None)
    single = _answers(planned.filter("strategy <> 'chunk'"), backend, config, [key, "strategy"]).select(key, "strategy", F.lit(1).alias("n_parts"), "answer", "error")
    many = planned.filter("strategy = 'chunk'").withColumn("content_hash", F.xxhash64("content", "instruction")).dropDuplicates([key, "content_hash", "content", "instruction"])
    parts = many.select(key, "content_hash", "instruction", F.posexplode(token_chunks_by(F.col("content"), F.col("chunk_budget"))).alias("pos", "content"), F.lit("full").alias("strategy"), "room")
    mapped = _answers(parts, backend, config, [key, "content_hash", "pos"])
    listed = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("answer", F.lit("")).alias("answer"))))
    joined = mapped.groupBy(key, "content_hash").agg(
        F.array_join(F.transform(listed, lambda x: x["answer"]), PART_BREAK).alias("content"), F.count(F.lit(1)).cast("int").alias("n_parts"), F.min(F.when(F.col("error").isNotNull(), F.struct("pos", "error")))["error"].alias("part_error")
    )
    merge = joined.filter("n_parts > 1 and part_error is null").withColumns({"instruction": F.lit("merge"), "strategy": F.lit("full"), "room": F.lit(0)})
    chunk = F.lit("chunk").alias("strategy")
    merged = _answers(merge, backend, config, [key, "n_parts"]).select(key, chunk, "n_parts", "answer", "error")
    alone = joined.filter("n_parts = 1 or part_error is not null").select(key, chunk, "n_parts", F.when(F.col("part_error").isNull(), F.col("content")).alias("answer"), F.col("part_error").alias("error"))
    return single.union(merged).union(alone).union(refused)


def distill_any(rows: DataFrame, backend: Backend, config: EngineConfig, text: str = "text", path: str | None = None) -> DataFrame:
    """rows with original_chars, before_tokens, after_tokens, savings_percent, skipped and content: texts under
    the gate are skipped, and so are those that got no shorter; tokens are estimates without calibration.

    path: the column of files to read where text is null or empty; a row with neither, or whose file can't be read,
    has an error.
    """
    from brevia.sources.files import text_or_path

    given = text_or_path(rows, text, path, "__source") if path else rows.withColumn("__source", F.col(text)).withColumn("__source_error", F.lit(None).cast("string"))
    whole = "__source_text"
    done = distill(given.withColumn(whole, F.col("__source")), backend, config, whole)
    error = F.coalesce("__source_error", "error")
    before, after = estimate_tokens(F.coalesce(F.col(whole), F.lit(""))), estimate_tokens(F.coalesce("content", F.lit("")))
    done = done.withColumn("error", error).withColumn("original_chars", u16_len(F.col(whole))).withColumn("before_tokens", before).withColumn("after_tokens", after)
    return done.withColumn("savings_percent", savings_percent(F.col("before_tokens"), F.col("after_tokens"))).withColumn("skipped", F.col("status").isin("passed", "unchanged") & F.col("error").isNull()).drop("__source", whole, "__source_error")


def chat_rows(prompts: DataFrame, base_url: str, model: str, timeout_ms: int = 120_000) -> DataFrame:
    """prompts (prompt or messages, files, system, temperature, num_predict, think) with the reply's fields and error.

    messages, an array of (role, content), go before prompt; system counts only beside a prompt; files, a
    text block, comes first as a system message. Missing model or text is an error in the row.
    """
    reply = "model string, content string, thinking string, total_duration_ms long, prompt_tokens long, completion_tokens long, tokens_per_second double, error string"

    def one(row: dict) -> dict:
        said = [dict(m) for m in row.get("messages") or []]
        if not said and (row.get("prompt") or "").strip():
            said = ([{"role": "system", "content": row["system"]}] if row.get("system") else []) + [{"role": "user", "content": row["prompt"]}]
        if not model or not said:
            return {"error": "no model" if not model else "no prompt and no messages"}
        if row.get("files"):
            said.insert(0, {"role": "system", "content": row["files"]})
        options = {name: row[name] for name in ("temperature", "num_predict") if row.get(name) is not None}
        try:
            return chat(base_url, model, said, options, row.get("think"), timeout_ms)
        except BackendError as error:
            return {"model": model, "error": str(error)}

    def run(batches):
        for batch in batches:
            replies = [one(row) for row in batch.to_pylist()]
            fields = [x.split() for x in reply.split(", ")]
            kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r.get(n) for r in replies], kinds[k]) for n, k in fields)], [*batch.schema.names, *(f"reply_{n}" for n, _ in fields)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema), *(f"reply_{x}" for x in reply.split(", "))])
    return prompts.mapInArrow(run, schema)


__all__ = ["auto_strategy", "chat_rows", "distill_any", "estimate", "plan", "run_over_files", "with_format"]
