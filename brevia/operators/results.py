"""Tool results, distilled when they are written: admission, reuse of earlier bytes, distillation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevia.config import EngineConfig
from brevia.functions.markers import DISTILL_PREFIX
from brevia.functions.text import content_hash, u16_len
from brevia.operators.distill import content_key, distill, passes_gate
from brevia.sources.backends import Backend
from brevia.sources.cache import evict_half

# Tools whose results are never distilled, and how many texts are remembered.
OWN_TOOLS = ("local_model_list", "local_model_running", "local_model_chat", "local_model_run", "local_model_distill")
REUSE_LIMIT = 2000


def total_units(content: Column) -> Column:
    return F.aggregate(content, F.lit(0).cast("long"), lambda n, b: n + F.coalesce(u16_len(b["text"]), F.lit(0)))


def admitted(config: EngineConfig) -> Column:
    """Accepted results of other tools, not nested, without a value, all text, and long enough together."""
    return F.coalesce(
        F.lit(config.distill_enabled)
        & (F.col("decision_kind") == "accept") & ~F.col("has_value") & ~F.col("is_nested") & ~F.col("tool_name").isin(*OWN_TOOLS)
        & (F.size("content") > 0) & F.forall("content", lambda b: b["type"] == "text") & (total_units(F.col("content")) >= config.distill_min_chars),
        F.lit(False),
    )


def block_gate(config: EngineConfig) -> Column:
    """By block: true where it would be distilled. Only the distill prefix is looked at here."""
    return F.transform("content", lambda b: (u16_len(b["text"]) >= config.distill_min_chars) & ~b["text"].startswith(DISTILL_PREFIX))


def first_written(rows: DataFrame, text: str, order: str) -> DataFrame:
    """rows with text_hash and first_at: where the same text was first seen; later ones reuse its bytes. Only hashes
    are aggregated; the texts stay where they are unless the table of hashes is too large to broadcast."""
    hashed = rows.withColumn("text_hash", content_hash(F.col(text)))
    first = hashed.groupBy("text_hash").agg(F.min(order).alias("first_at"))
    return hashed.join(first, hashed["text_hash"].eqNullSafe(first["text_hash"])).drop(first["text_hash"])


def distill_results(results: DataFrame, backend: Backend, config: EngineConfig, remembered: DataFrame | None = None) -> DataFrame:
    """(exec_id, ..., content) with the admitted results' long blocks distilled, and changed.

    remembered: (content_hash, content) of texts distilled before, whose bytes are used again; see remember().
    """
    marked = results.withColumn("__brevia_admitted", admitted(config))
    done = distill(_admitted_blocks(marked, config), backend, config, cache=remembered).filter("status in ('distilled', 'cached') and content <> text")
    swaps = done.groupBy("exec_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "content"))).alias("__brevia_swaps"))
    joined = marked.join(swaps, "exec_id", "left")
    swapped = F.transform("content", lambda b, k: b.withField("text", F.coalesce(F.col("__brevia_swaps")[k], b["text"])))
    changed = F.col("__brevia_admitted") & F.col("__brevia_swaps").isNotNull()
    return joined.withColumn("changed", changed).withColumn("content", F.when(changed, swapped).otherwise(F.col("content"))).drop("__brevia_swaps", "__brevia_admitted")


def _admitted_blocks(marked: DataFrame, config: EngineConfig) -> DataFrame:
    """(exec_id, i, text) of the blocks to distil."""
    blocks = marked.filter("__brevia_admitted").select("exec_id", F.posexplode("content").alias("i", "b")).select("exec_id", "i", F.col("b.text").alias("text"))
    return blocks.filter(passes_gate(F.col("text"), config))


def remember(results: DataFrame, backend: Backend, config: EngineConfig, remembered: DataFrame | None = None, limit: int = REUSE_LIMIT) -> DataFrame:
    """(content_hash, content, inserted) after these results: first write wins, and a full table drops its older half.
    Texts that didn't get shorter are remembered as they are; failures aren't. inserted: the text's first exec_id."""
    marked = results.withColumn("__brevia_admitted", admitted(config))
    done = distill(_admitted_blocks(marked, config), backend, config, cache=remembered).filter("status in ('distilled', 'unchanged')")
    fresh = done.groupBy(content_key(F.col("text"), config).alias("content_hash")).agg(F.min_by("content", "exec_id").alias("content"), F.min("exec_id").alias("inserted"))
    every = fresh if remembered is None else remembered.select("content_hash", "content", "inserted").union(fresh)
    left = evict_half(every, limit)
    return every.groupBy("content_hash").agg(F.min_by("content", "inserted").alias("content")).join(left, "content_hash").select("content_hash", "content", "inserted")
