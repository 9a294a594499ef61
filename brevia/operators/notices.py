"""Notices: one report of savings for each request that was changed, none twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevia.config import EngineConfig
from brevia.functions.markers import mark_line, read_mark
from brevia.functions.text import savings_percent


def thousands(tokens: Column) -> Column:
    """1234 as 1.2K."""
    return F.format_string("%.1fK", tokens / 1000)


def mark_lines(messages: DataFrame) -> DataFrame:
    """(conv_id, mark) of every distilled text in messages, those in tool results too."""
    inner = F.flatten(F.transform("content", lambda b: F.coalesce(b["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    own = F.transform("content", lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text")))
    texts = F.filter(F.concat(own, inner), lambda x: x["type"] == "text")
    return messages.select("conv_id", F.explode(F.transform(texts, lambda x: mark_line(x["text"]))).alias("mark")).filter("mark is not null")


def mark_totals(marks: DataFrame, *group: str) -> DataFrame:
    """(group..., n_marks, n_parsed, chars, before, after, percent, any_mark, row_text, card_text).

    The collapsed row counts all lines, the card only those it can read; one line alone is given as it is.
    """
    read = marks.withColumn("m", read_mark(F.col("mark")))
    sums = read.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_marks"), F.count("m").alias("n_parsed"), F.coalesce(F.sum("m.chars"), F.lit(0)).alias("chars"),
        F.coalesce(F.sum("m.before"), F.lit(0)).alias("before"), F.coalesce(F.sum("m.after"), F.lit(0)).alias("after"), F.min("mark").alias("any_mark"), F.min(F.when(F.col("m").isNotNull(), F.col("mark"))).alias("one_mark"),
    )
    sums = sums.withColumn("percent", savings_percent(F.col("before"), F.col("after")))
    figures = F.format_string("%d characters, %d to %d tokens (%d %% saved)", "chars", "before", "after", "percent")
    row = F.when((F.col("n_marks") == 1) | (F.col("before") == 0), F.col("any_mark")).otherwise(F.concat(F.format_string("%d texts shortened: ", "n_marks"), figures))
    card = F.when(F.col("n_parsed") == 1, F.col("one_mark")).when(F.col("n_parsed") > 1, F.concat(F.format_string("%d texts: ", "n_parsed"), figures))
    return sums.withColumn("row_text", row).withColumn("card_text", card).drop("one_mark")


def notices(pruned: DataFrame, fresh: DataFrame, breakdown: DataFrame, config: EngineConfig, sent: DataFrame | None = None) -> DataFrame:
    """(conv_id, notice_key, summary, text) of requests that have something new to report.

    pruned: prune_history()'s rows; fresh: (conv_id, mark, content_hash) of texts distilled in this request;
    breakdown: accounting.breakdown() of what is sent; sent: (conv_id, notice_key) of notices given before.
    """
    marks = fresh.groupBy("conv_id").agg(F.array_sort(F.collect_set("content_hash")).alias("fresh_ids"), F.count(F.lit(1)).alias("n_fresh"))
    totals = mark_totals(fresh.select("conv_id", "mark"), "conv_id").select("conv_id", "row_text", "card_text")
    rows = breakdown.join(pruned.drop("content_hash"), "conv_id", "left").join(marks, "conv_id", "left").join(totals, "conv_id", "left")
    is_pruned = F.col("chain_key").isNotNull() & F.lit(config.prune_notice)
    is_fresh = F.col("n_fresh").isNotNull() & F.lit(config.distill_notice)
    before = F.coalesce(F.col("before_tokens"), F.col("conversation_tokens") + F.col("history_tokens")) + F.col("system_tokens") + F.col("tools_tokens")
    rows = rows.withColumn("before", before).withColumn("saved", savings_percent(F.col("before"), F.col("total_tokens")))
    key = F.concat_ws("|", F.when(is_pruned, F.concat(F.lit("p|"), F.col("chain_key"))), F.when(is_fresh, F.concat(F.lit("m|"), F.array_join("fresh_ids", ","))))
    rows = rows.withColumn("notice_key", F.when(is_pruned | is_fresh, key).otherwise(F.concat(F.lit("stats|"), F.col("total_tokens").cast("string"))))
    if not config.distill_notice_always:
        rows = rows.filter(is_pruned | is_fresh)
    action = F.when(F.col("newly") > 0, F.format_string("%d turns summarised", "newly")).otherwise(F.format_string("summaries cover %d turns", "covered"))
    summary = F.when(is_pruned, F.concat(action, F.format_string(", %d %% saved", "saved"), F.when(is_fresh, F.format_string(", %d texts shortened", "n_fresh")).otherwise(""))).when(is_fresh, F.col("row_text")).otherwise(F.concat(F.lit("input "), thousands(F.col("before")), F.lit(" tokens")))
    line = lambda name, c: F.when(c > 0, F.concat(F.lit(f"- {name}: "), thousands(c)))
    text = F.concat_ws(
        "\n", F.concat(F.lit("sent "), thousands(F.col("total_tokens")), F.lit(" of "), thousands(F.col("before")), F.lit(" tokens")),
        line("system", F.col("system_tokens")), line("tools", F.col("tools_tokens")), line("summaries", F.col("history_tokens")), line("conversation", F.col("conversation_tokens")), F.col("card_text"),
    )
    out = rows.select("conv_id", "notice_key", summary.alias("summary"), text.alias("text")).dropDuplicates(["conv_id", "notice_key"])
    return out if sent is None else out.join(sent, ["conv_id", "notice_key"], "left_anti")


def as_events(found: DataFrame) -> DataFrame:
    """Notices as session events to append."""
    return found.select("conv_id", F.lit("user/message").alias("type"), F.lit("user").alias("role"), "text", F.struct(F.lit("plugin").alias("kind"), F.lit("brevia").alias("plugin"), F.lit("notice").alias("form"), "summary").alias("source"), F.lit("append").alias("op"))
