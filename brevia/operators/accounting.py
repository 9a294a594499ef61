"""Token accounting: what a provider bills of messages and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevia.config import EngineConfig
from brevia.functions.markers import PRUNE_PREFIX
from brevia.functions.text import calibrated_tokens


def _strings(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


_EMPTY = "array<struct<type:string,text:string>>"


def _inner(b: Column) -> Column:
    """The texts inside a tool result."""
    held = F.coalesce(b["content"], F.array().cast(_EMPTY))
    return F.transform(F.filter(held, lambda x: x["type"] == "text"), lambda x: x["text"])


def flattened_texts(content: Column) -> Column:
    """The non-empty texts of a message in order, those inside tool results too."""
    def of(b):
        return F.when(b["type"] == "text", F.array(b["text"])).when(b["type"] == "tool-result", _inner(b)).otherwise(F.array().cast("array<string>"))

    return F.filter(F.flatten(F.transform(content, of)), lambda t: t.isNotNull() & (t != ""))


def has_block(content: Column, kind: str) -> Column:
    return F.coalesce(F.exists(content, lambda b: b["type"] == kind), F.lit(False))


def has_tool_result(role: Column, content: Column) -> Column:
    return (role == "tool") | has_block(content, "tool-result")


def has_tool_call(role: Column, content: Column, tool_calls: Column | None = None) -> Column:
    """tool_calls: the array of calls beside the content that older messages carry."""
    called = has_block(content, "tool-call")
    return (role == "assistant") & (called if tool_calls is None else called | F.coalesce(F.size(tool_calls) > 0, F.lit(False)))


def billed_fragments(role: Column, content: Column) -> Column:
    """What is billed: texts (empty ones too), arguments of tool calls, texts in tool results, and reasoning
    only on assistant turns with a tool call."""
    reasons = has_tool_call(role, content)

    def of(b):
        kind = b["type"]
        return (
            F.when((kind == "text") | ((kind == "reasoning") & reasons), _strings(b["text"]))
            .when(kind == "tool-call", _strings(b["arguments"]))
            .when(kind == "tool-result", F.filter(_inner(b), lambda t: t.isNotNull()))
            .otherwise(F.array().cast("array<string>"))
        )

    return F.flatten(F.transform(content, of))


def sum_tokens(fragments: Column, factor: float) -> Column:
    """Every fragment is estimated and rounded by itself."""
    return F.aggregate(fragments, F.lit(0).cast("long"), lambda total, t: total + calibrated_tokens(t, factor))


def message_tokens(messages: DataFrame, config: EngineConfig) -> DataFrame:
    """messages with tokens and is_history: whether one is a pruned block."""
    history = F.coalesce(F.exists("content", lambda b: (b["type"] == "text") & b["text"].startswith(PRUNE_PREFIX)), F.lit(False))
    fragments = billed_fragments(F.col("role"), F.col("content"))
    return messages.withColumn("tokens", sum_tokens(fragments, config.token_estimate_factor)).withColumn("is_history", history)


def overhead_tokens(system: Column, tools_json: Column, config: EngineConfig) -> tuple[Column, Column]:
    """Tokens of a request's system text and of its tools' JSON, 0 where there is none."""
    factor = config.token_estimate_factor
    tools = F.when(tools_json.isNotNull() & (tools_json != "[]"), calibrated_tokens(tools_json, factor)).otherwise(0)
    return F.when(system.isNotNull(), calibrated_tokens(system, factor)).otherwise(0), tools


def breakdown(messages: DataFrame, requests: DataFrame, config: EngineConfig) -> DataFrame:
    """(conv_id, system_tokens, tools_tokens, history_tokens, conversation_tokens, total_tokens)."""
    priced = message_tokens(messages, config)
    sums = priced.groupBy("conv_id").agg(
        F.sum(F.when(F.col("is_history"), F.col("tokens")).otherwise(0)).alias("history_tokens"), F.sum(F.when(F.col("is_history"), 0).otherwise(F.col("tokens"))).alias("conversation_tokens")
    )
    system, tools = overhead_tokens(F.col("system"), F.col("tools_json"), config)
    joined = sums.join(requests, "conv_id", "left").select("conv_id", system.cast("long").alias("system_tokens"), tools.cast("long").alias("tools_tokens"), "history_tokens", "conversation_tokens")
    return joined.withColumn("total_tokens", F.expr("system_tokens + tools_tokens + history_tokens + conversation_tokens"))


# --- positions within a conversation ------------------------------------------------------------------


def positions(priced: DataFrame, config: EngineConfig) -> DataFrame:
    """from_end (1: the last), in_keep_zone, rollable (all but the last), and suffix_tokens: the sum from here on."""
    back = Window.partitionBy("conv_id").orderBy(F.col("seq").desc())
    suffix = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        priced.withColumn("from_end", F.row_number().over(back))
        .withColumn("in_keep_zone", F.col("from_end") <= config.prune_keep_recent)
        .withColumn("rollable", F.col("from_end") > 1)
        .withColumn("suffix_tokens", F.sum("tokens").over(suffix))
    )


def prune_candidates(priced: DataFrame, config: EngineConfig, chained: DataFrame | None = None) -> DataFrame:
    """(conv_id, n_messages, tokens, eligible). chained: the conv_id of conversations with a valid chain, which are
    looked at however small they are."""
    sums = priced.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.sum("tokens").alias("tokens"))
    on = config.prune_enabled and config.prune_budget_tokens > 0
    due = F.col("tokens") > F.lit(float(config.threshold))
    if chained is not None:
        sums = sums.join(chained.select("conv_id").distinct().withColumn("__chained", F.lit(True)), "conv_id", "left")
        due = due | F.coalesce("__chained", F.lit(False))
    return sums.withColumn("eligible", F.lit(on) & (F.col("n_messages") > config.prune_keep_recent) & due).drop("__chained")


def roll_plan(candidates: DataFrame, config: EngineConfig, has_chain: bool = False) -> DataFrame:
    """overage, batch and cap: how far a request is over its threshold, and how much may be rolled at once."""
    first = config.prune_max_new_blocks if has_chain else max(config.prune_max_new_blocks, 8)
    size = config.prune_batch_size
    grown = F.least(F.lit(48), F.greatest(F.lit(12), F.floor(F.col("overage") + 0.5) * 3))
    return (
        candidates.withColumn("overage", F.col("tokens") / F.lit(float(config.threshold)))
        .withColumn("batch", F.when(F.col("overage") > 2, max(3 * size, 48)).otherwise(size))
        .withColumn("cap", F.when(F.col("overage") > 1, F.greatest(F.lit(first), grown)).otherwise(first).cast("int"))
    )
