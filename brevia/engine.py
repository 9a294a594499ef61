"""The engine: settings, a backend and a session put together, with every stage in its order.

Tool results are distilled when they are written, before anything else sees them. A request is pruned first, then what
is left of it is distilled, then reported. Caches live under distill_cache_path: distilled texts, remembered results
and conversations' chains, each a table of its own that is swapped in whole.
"""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia import sql
from brevia.config import EngineConfig
from brevia.functions.text import content_hash
from brevia.operators import accounting, distill, notices, prune, results, run
from brevia.sources import cache, models
from brevia.sources.backends import Backend, HttpBackend

log = logging.getLogger("brevia")

#: What a host may tell its model, by place: the tools, when to use them, what marked texts are.
GUIDANCE = (
    (160, "Tools on a local model: list models, running models, chat, run an instruction over files, distil a text."),
    (161, "Give a local model what is long, private or repetitive; keep what needs judgement."),
    (162, "Texts between marks of distillation or pruning are summaries with their figures; read the source again for exact wording."),
)


@dataclass
class Prepared:
    """A request as it is sent: messages with changed, the conversations that were pruned, and what is reported. path:
    where their tables are, to be deleted once the request is sent; None if they are computed when read."""

    messages: DataFrame
    pruned: DataFrame
    notices: DataFrame
    path: str | None = None


class Engine:
    """Engine(spark, EngineConfig(...)): without a backend, the model server at base_url with summary_model; without a
    model, or with enabled off, texts pass as they are."""

    def __init__(self, spark: SparkSession, config: EngineConfig | None = None, backend: Backend | None = None):
        self.spark, self.config = spark, config or EngineConfig()
        self.backend = backend or (HttpBackend(self.config.base_url, self.config.summary_model) if self.config.summary_model else None)
        self.active = self.config.enabled and self.backend is not None
        if self.config.enabled and self.backend is None and (self.config.distill_enabled or self.config.prune_enabled):
            log.warning("no model is set (distill_model or default_model): nothing is distilled or pruned")
        if self.config.enabled:
            sql.register(spark)

    def guidance(self) -> list[tuple[int, str]]:
        """(place, text) of what is to be told, by announce_to_agent, routing_guidance and distill_enabled."""
        c = self.config
        told = (c.announce_to_agent, c.announce_to_agent and c.routing_guidance, c.announce_to_agent and c.distill_enabled)
        return [g for g, wanted in zip(GUIDANCE, told, strict=True) if c.enabled and wanted]

    def tools(self) -> dict:
        """The tools by name."""
        if not self.config.enabled:
            return {}
        c = self.config
        return {
            "list_models": lambda: models.catalogue(self.spark, c.base_url, "installed"),
            "running_models": lambda: models.catalogue(self.spark, c.base_url, "running"),
            "chat": lambda prompts, model=c.default_model: run.chat_rows(prompts, c.base_url, model, c.timeout_ms),
            "run_files": lambda tasks, key, **more: run.run_over_files(tasks, self._backend(), c, key, **more),
            "distill": lambda rows, text="text", path=None: run.distill_any(rows, self._backend(), c, text, path),
        }

    def _backend(self) -> Backend:
        if self.backend is None:
            raise ValueError("no model is set (distill_model or default_model)")
        return self.backend

    # --- caches

    def _at(self, name: str) -> str | None:
        return f"{self.config.distill_cache_path.rstrip('/')}/{name}" if self.config.distill_cache_path else None

    def _load(self, name: str) -> DataFrame | None:
        at = self._at(name)
        return cache.load(self.spark, at) if at else None

    def _keep(self, name: str, fresh: DataFrame) -> None:
        """Adds to a cache; the first to be written wins, and the oldest go beyond distill_cache_limit."""
        at = self._at(name)
        if at:
            cache.save(cache.merge(cache.load(self.spark, at), fresh, self.config.distill_cache_limit), at)

    def _chains(self, messages: DataFrame) -> DataFrame | None:
        kept = self._load("chains")
        if kept is None:
            return None
        kind = ", ".join(f"{x}" for x in f"{prune.CHAIN}, {prune.KNOWN}".split(", "))
        known = kept.select(F.col("content_hash").alias("conv_key"), F.from_json("content", kind).alias("x")).select("conv_key", "x.*")
        return prune.recall(messages, known)

    def _keep_chains(self, messages: DataFrame, pruned: DataFrame, at: int) -> None:
        """A conversation's newest chain takes the place of the one before."""
        path = self._at("chains")
        if not path:
            return
        found = prune.snapshots(messages, pruned)
        fresh = found.select(F.col("conv_key").alias("content_hash"), F.to_json(F.struct(*(c for c in found.columns if c != "conv_key"))).alias("content"), F.lit(at).cast("long").alias("inserted"))
        old = cache.load(self.spark, path).join(fresh.select("content_hash"), "content_hash", "left_anti")
        cache.save(cache.evict_oldest(old.select(fresh.columns).union(fresh), self.config.distill_cache_limit), path)

    # --- stages

    def write_results(self, tool_results: DataFrame) -> DataFrame:
        """Tool results as they are stored: distill_results(), with the bytes of texts that were seen before. To be
        written before the next call but one, as the cache keeps one older version."""
        if not self.active:
            return tool_results.withColumn("changed", F.lit(False))
        known = self._load("results")
        if known is not None:
            self._keep("results", results.remember(tool_results, self.backend, self.config, known))
            known = self._load("results")
        return results.distill_results(tool_results, self.backend, self.config, known)

    def prepare(self, messages: DataFrame, requests: DataFrame, sent: DataFrame | None = None, at: int = 0) -> Prepared:
        """Messages of requests (conv_id, system, tools_json) as they are sent. at: the request's number, by which caches
        know what is older; sent: (conv_id, notice_key) of earlier notices."""
        c = self.config
        none = messages.limit(0).select("conv_id", F.lit("").alias("notice_key"), F.lit("").alias("summary"), F.lit("").alias("text"))
        if not self.active:
            return Prepared(messages.withColumn("changed", F.lit(False)), self.spark.createDataFrame([], prune.RESULT), none)
        system, tools = accounting.overhead_tokens(F.col("system"), F.col("tools_json"), c)
        overheads = requests.select("conv_id", (system + tools).alias("overhead"))
        pruned = prune.prune_history(messages, self.backend, c, self._chains(messages), overheads)
        path = self._at(f"sent-{uuid.uuid4().hex}")
        if path:  # each block is made once: what follows reads the table
            pruned = self._stored(f"{path}/pruned", pruned)
            self._keep_chains(messages, pruned, at)
        left = prune.assemble(messages, pruned)
        out = distill.distill_messages(left, self.backend, c, self._load("texts"))
        if path:
            texts = left.filter(F.col("role").isin(*c.distill_roles)).select(F.explode(accounting.flattened_texts(F.col("content"))).alias("text"))
            done = distill.distill(texts.distinct(), self.backend, c, cache=self._load("texts")).filter("status = 'distilled'")
            self._keep("texts", done.select(distill.content_key(F.col("text"), c).alias("content_hash"), "content", F.lit(at).cast("long").alias("inserted")))
            out = self._stored(f"{path}/messages", distill.distill_messages(left, self.backend, c, self._load("texts")))
        marks = notices.mark_lines(out.filter("changed")).withColumn("content_hash", content_hash(F.col("mark")))
        return Prepared(out, pruned, notices.notices(pruned, marks, accounting.breakdown(out, requests, c), c, sent), path)

    def _stored(self, at: str, df: DataFrame) -> DataFrame:
        df.write.parquet(at)
        return self.spark.read.parquet(at)


def observed(done: DataFrame, name: str = "distilled") -> DataFrame:
    """distill()'s rows with metrics that a query listener or an Observation of that name receives."""
    of = lambda status: F.count_if(F.col("status") == status).alias(status)
    return done.observe(name, F.count(F.lit(1)).alias("rows"), of("distilled"), of("cached"), of("failed"), of("blocked"), F.sum("before_tokens").alias("before_tokens"), F.sum("after_tokens").alias("after_tokens"))
