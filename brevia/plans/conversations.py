"""Queries over conversations: accounting, positions, pruning, distillation and notices."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.config import EngineConfig
from brevia.functions.markers import DISTILL_CLOSE, DISTILL_PREFIX, PRUNE_PREFIX
from brevia.functions.text import content_hash, fingerprint, fingerprint36, u16_len
from brevia.operators import accounting as A
from brevia.operators import distill as D
from brevia.operators import notices as N
from brevia.operators import prune as P
from brevia.plans import foldsql as W
from brevia.plans import sqltext as S
from brevia.plans.registry import query
from brevia.schema import BLOCK, from_conversations
from brevia.sources.backends import PrefixBackend
from brevia.sources.shared import kept

#: Settings under which the test conversations, of some 800 tokens, are pruned and distilled.
SMALL = EngineConfig(
    prune_budget_tokens=600, prune_keep_recent=2, prune_batch_size=2, prune_max_source_chars=1500, token_estimate_factor=1.25,
    distill_min_chars=1000, distill_roles=("assistant",), distill_chunk_chars=10_000_000, distill_call_budget=1,
)
PLAIN = EngineConfig(prune_budget_tokens=600, prune_keep_recent=2, prune_batch_size=2)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_conversations(turns(spark, sf_dir))


def priced(spark, sf_dir, config=PLAIN) -> DataFrame:
    return A.message_tokens(messages(spark, sf_dir), config)


@query(f"SELECT conv_id, turn, role, {S.u16('text')} AS n_chars FROM conversations")
def msg_scan(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", "role", u16_len(F.col("text")).alias("n_chars"))


@query(f"SELECT conv_id, turn, role = 'assistant' AND {S.u16('text')} >= 1000 AND NOT starts_with(text, '{DISTILL_PREFIX}') AND NOT starts_with(text, '{PRUNE_PREFIX}') AS eligible FROM conversations")
def distill_gate(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", (F.col("role").isin(*SMALL.distill_roles) & D.passes_gate(F.col("text"), SMALL)).alias("eligible"))


@query(f"SELECT conv_id, count(*) AS n_messages, sum({S.calibrated('text', 1.25)})::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def billed_tokens(spark, sf_dir):
    return priced(spark, sf_dir, SMALL).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.sum("tokens").alias("tokens"))


@query(f"""WITH s AS (SELECT conv_id, max(text) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id),
    m AS (SELECT conv_id, sum(CASE WHEN turn = 1 THEN {S.calibrated(f"'{PRUNE_PREFIX}·' || text", 1.25)} ELSE 0 END)::BIGINT AS history_tokens,
        sum(CASE WHEN turn = 1 THEN 0 ELSE {S.calibrated("text", 1.25)} END)::BIGINT AS conversation_tokens FROM conversations WHERE role <> 'system' GROUP BY conv_id),
    t AS (SELECT m.conv_id, CASE WHEN s.system IS NULL THEN 0 ELSE {S.calibrated("s.system", 1.25)} END AS system_tokens,
        CASE WHEN m.conv_id % 2 = 0 THEN {S.calibrated("""'[{"name":"' || m.conv_id || '"}]'""", 1.25)} ELSE 0 END AS tools_tokens, history_tokens, conversation_tokens FROM m LEFT JOIN s USING (conv_id))
    SELECT *, system_tokens + tools_tokens + history_tokens + conversation_tokens AS total_tokens FROM t""")
def token_breakdown(spark, sf_dir):
    """System turns as the request's system text, turn 1 as a summary block, tools on every other conversation."""
    rows = turns(spark, sf_dir)
    tools = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('[{"name":"'), F.col("conv_id").cast("string"), F.lit('"}]'))).otherwise("[]")
    system = rows.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "system", F.col("text"))).alias("system")).withColumn("tools_json", tools)
    marked = rows.filter("role <> 'system'").withColumn("text", F.when(F.col("turn") == 1, F.concat(F.lit(f"{PRUNE_PREFIX}·"), F.col("text"))).otherwise(F.col("text")))
    return A.breakdown(from_conversations(marked), system, SMALL)


_PRICED = f"(SELECT conv_id, turn, {S.estimate('text')} AS tokens FROM conversations)"
_CANDIDATES = f"(SELECT conv_id, count(*) AS n_messages, sum(tokens)::BIGINT AS tokens FROM {_PRICED} GROUP BY conv_id)"


@query(f"SELECT conv_id, n_messages, tokens, n_messages > 2 AND tokens > 720 AS eligible FROM {_CANDIDATES}")
def prune_candidates(spark, sf_dir):
    return A.prune_candidates(priced(spark, sf_dir), PLAIN)


@query(f"""SELECT conv_id, overage, CASE WHEN overage > 2 THEN 48 ELSE 2 END AS batch, CASE WHEN overage > 1 THEN greatest(8, least(48, greatest(12, floor(overage + 0.5::DOUBLE)::INTEGER * 3))) ELSE 8 END AS cap
    FROM (SELECT conv_id, tokens / 720.0::DOUBLE AS overage FROM {_CANDIDATES})""")
def roll_plan(spark, sf_dir):
    return A.roll_plan(A.prune_candidates(priced(spark, sf_dir), PLAIN), PLAIN).select("conv_id", "overage", "batch", "cap")


@query(f"""SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC))::INTEGER AS from_end, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2 AS in_keep_zone,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 1 AS rollable FROM {_PRICED}""")
def keep_zone(spark, sf_dir):
    return A.positions(priced(spark, sf_dir), PLAIN).select("conv_id", F.col("seq").alias("turn"), "from_end", "in_keep_zone", "rollable")


@query(f"SELECT conv_id, turn, tokens, (sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS suffix_tokens FROM {_PRICED}")
def suffix_tokens(spark, sf_dir):
    return A.positions(priced(spark, sf_dir), PLAIN).select("conv_id", F.col("seq").alias("turn"), "tokens", "suffix_tokens")


@query(f"SELECT conv_id, turn, {S.fnv1a('text')} AS fnv, lower(to_base({S.fnv1a('text')}, 36)) AS fnv36, substring(sha256(text), 1, 16) AS sha16 FROM conversations")
def msg_fingerprint(spark, sf_dir):
    text = F.col("text")
    return turns(spark, sf_dir).select("conv_id", "turn", fingerprint(text).alias("fnv"), fingerprint36(text).alias("fnv36"), content_hash(text).alias("sha16"))


@query(f"""SELECT conv_id, lower(to_base({S.fnv1a("head")}, 36)) AS first_key, lower(to_base({S.fnv1a("front")}, 36)) AS front_hash FROM (
    SELECT conv_id, min_by(text, turn) AS head, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE place <= 3) AS front
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) GROUP BY conv_id)""")
def prefix_hash(spark, sf_dir):
    """Fingerprints of each conversation's first turn and of its first three, as keys of its chain."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    grouped = turns(spark, sf_dir).groupBy("conv_id").agg(F.min_by("text", "turn").alias("head"), F.slice(ordered, 1, 3).alias("front"))
    return grouped.select("conv_id", fingerprint36(F.col("head")).alias("first_key"), fingerprint36(F.array_join(F.transform("front", lambda x: x["text"]), "\n")).alias("front_hash"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 0 ELSE 1 END + CASE WHEN text <> '' THEN 1 ELSE 0 END AS n_texts, md5(CASE WHEN turn % 2 = 0 THEN coalesce(text, '') ELSE coalesce(nullif(text, '') || '|', '') || 'result ' || turn END) AS digest FROM conversations""")
def flatten_text(spark, sf_dir):
    """Odd turns with a reasoning block, an empty text and a tool result around a text."""
    rows = turns(spark, sf_dir)
    inner = F.expr("array(struct('text' as type, concat('result ', turn) as text))")
    empty = ", ".join(f"'{k}', cast(null as string)" for k in ("id", "name", "arguments", "tool_call_id"))
    plain = F.expr(f"from_json(to_json(array(named_struct('type', 'text', 'text', text, {empty}))), 'array<{BLOCK}>')")
    rows = rows.withColumn("inner", inner)
    extra = F.expr(f"from_json(to_json(array(struct('reasoning' as type, 'hidden' as text), struct('text' as type, '' as text))), 'array<{BLOCK}>')")
    nested = F.expr(f"from_json(to_json(array(named_struct('type', 'tool-result', 'content', inner))), 'array<{BLOCK}>')")
    content = F.when(F.col("turn") % 2 == 0, plain).otherwise(F.concat(plain, extra, nested))
    texts = A.flattened_texts(F.col("content"))
    return rows.withColumn("content", content).select("conv_id", "turn", F.size(texts).alias("n_texts"), F.md5(F.array_join(texts, "|").cast("binary")).alias("digest"))


# --- distillation of conversations -----------------------------------------------------------------------


@query(f"""WITH c AS (SELECT *, role = 'assistant' AND {S.u16("text")} >= 1000 AND NOT starts_with(text, '⟦') AS eligible, {S.trimmed(S.prefix("text", 0.4))} AS short FROM conversations),
    first AS (SELECT conv_id, text, min(turn) AS turn FROM c WHERE eligible GROUP BY conv_id, text),
    paid AS (SELECT DISTINCT text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM first) WHERE place <= 1),
    j AS (SELECT c.*, p.text IS NOT NULL AS is_paid, {S.calibrated("c.text", 1.25)} AS b, {S.calibrated("short", 1.25)} AS a FROM c LEFT JOIN paid p ON c.eligible AND c.text = p.text)
    SELECT conv_id, turn, CASE WHEN NOT eligible THEN 'passed' WHEN is_paid THEN 'distilled' ELSE 'over_budget' END AS status, is_paid AS changed,
        md5(CASE WHEN is_paid THEN {S.distill_line(S.u16("text"), "b", "a")} || chr(10) || short || chr(10) || '{DISTILL_CLOSE}' ELSE text END) AS digest FROM j""")
def distill_conversations(spark, sf_dir):
    done = D.distill_conversations(turns(spark, sf_dir), PrefixBackend(), SMALL)
    return done.select("conv_id", "turn", "status", "changed", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"""WITH c AS (SELECT *, role = 'assistant' AND {S.u16("text")} >= 1000 AS eligible, {S.trimmed(S.prefix("text", 0.4))} AS short, {S.calibrated("text", 1.25)} AS b FROM conversations)
    SELECT conv_id, turn, eligible AS changed, md5(CASE WHEN eligible THEN {S.distill_line(S.u16("text"), "b", S.calibrated("short", 1.25))} || chr(10) || short || chr(10) || '{DISTILL_CLOSE}' ELSE text END) AS digest FROM c""")
def distill_messages(spark, sf_dir):
    """The same on messages with nested blocks."""
    done = D.distill_messages(messages(spark, sf_dir), PrefixBackend(), SMALL)
    return done.select("conv_id", F.col("seq").alias("turn"), "changed", F.md5(F.col("content")[0]["text"].cast("binary")).alias("digest"))


# --- pruning -------------------------------------------------------------------------------------------------

_MOST = SMALL.prune_max_source_chars


@query(f"""WITH r AS (SELECT *, {_MOST} - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM conversations WHERE text <> '')
    SELECT conv_id, md5(string_agg(right(text, least(length(text), room)::BIGINT), chr(10) || chr(10) ORDER BY turn)) AS digest FROM r WHERE room > 0 GROUP BY conv_id""")
def prune_source(spark, sf_dir):
    found = P.source_window(turns(spark, sf_dir).withColumnRenamed("turn", "seq"), SMALL)
    return found.select("conv_id", F.md5(F.col("source").cast("binary")).alias("digest"))


@query(f"""WITH r AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations)
    SELECT conv_id, count(*) AS n_taken, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM r WHERE place = 1 OR size <= {_MOST} GROUP BY conv_id""")
def compact_source(spark, sf_dir):
    found = P.whole_block_window(turns(spark, sf_dir).withColumnRenamed("turn", "seq"), _MOST)
    return found.select("conv_id", "n_taken", F.md5(F.col("source").cast("binary")).alias("digest"))


def _digest(done: DataFrame) -> DataFrame:
    blocks = F.array_join("block_texts", "\n\n")
    return done.select("conv_id", "n_messages", "covered", F.size("block_texts").alias("n_blocks"), "newly", "before_tokens", "after_tokens", F.md5(blocks.cast("binary")).alias("digest"))


@query(W.pruned_rows(PLAIN))
def prune_history(spark, sf_dir):
    return _digest(P.prune_history(messages(spark, sf_dir), PrefixBackend(), PLAIN))


#: One turn to a block, and chains of more than two blocks merged.
SHORT = replace(PLAIN, prune_batch_size=1, prune_keep_recent=1, prune_chain_max_batches=2)


@query(W.pruned_rows(SHORT))
def prune_compact(spark, sf_dir):
    return _digest(P.prune_history(messages(spark, sf_dir), PrefixBackend(), SHORT))


@query(f"""WITH t AS (SELECT conv_id, count(*) AS n, sum({S.estimate("text")}) AS tokens FROM conversations GROUP BY conv_id)
    SELECT conv_id, coalesce(made + p.n - pos, t.n)::BIGINT AS n_sent, coalesce(chain + list_sum(p.tokens[pos + 1:p.n]), t.tokens)::BIGINT AS tokens, coalesce(made, 0)::BIGINT AS n_blocks FROM t LEFT JOIN {W.pruned(PLAIN)} p USING (conv_id)""")
def prune_assemble(spark, sf_dir):
    """What is sent after pruning: blocks, then the turns left."""
    sent = messages(spark, sf_dir)
    out = A.message_tokens(P.assemble(sent, P.prune_history(sent, PrefixBackend(), PLAIN)), PLAIN)
    return out.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_sent"), F.sum("tokens").alias("tokens"), F.count_if("is_history").alias("n_blocks"))


@query(W.notices(PLAIN, SMALL))
def notices(spark, sf_dir):
    """Prune, then distil what is left, then report."""
    sent = messages(spark, sf_dir)
    pruned = kept(P.prune_history(sent, PrefixBackend(), PLAIN))  # used by what is sent and by the report
    done = kept(D.distill_messages(P.assemble(sent, pruned), PrefixBackend(), SMALL))
    marks = N.mark_lines(done).withColumn("content_hash", content_hash(F.col("mark")))
    nothing = sent.select("conv_id").distinct().withColumns({"system": F.lit(None).cast("string"), "tools_json": F.lit("[]")})
    return N.notices(pruned, marks, A.breakdown(done, nothing, PLAIN), PLAIN)
