"""Queries over sessions: pairing, folding, boundaries and stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.operators import session as Z
from brevia.plans import foldsql as W
from brevia.plans.conversations import PLAIN, messages
from brevia.plans.registry import query
from brevia.schema import BLOCK
from brevia.sources.backends import PrefixBackend

_CALLS = "(SELECT user_id AS conv_id, props AS call_id, event_id AS seq FROM events WHERE event_type IN ('click', 'view'))"
_RESULTS = "(SELECT user_id AS conv_id, props AS call_id, event_id AS seq FROM events WHERE event_type IN ('purchase', 'error'))"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def calls(spark, sf_dir) -> DataFrame:
    """Events as tool calls and results: clicks and views call, purchases and errors answer, props is the identifier."""
    return events(spark, sf_dir).filter("event_type in ('click', 'view')").select(F.col("user_id").alias("conv_id"), F.col("props").alias("call_id"), F.col("event_id").alias("seq"))


def results(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).filter("event_type in ('purchase', 'error')").select(F.col("user_id").alias("conv_id"), F.col("props").alias("call_id"), F.col("event_id").alias("seq"))


@query(f"SELECT c.conv_id, c.call_id, c.seq AS call_seq, min(r.seq) AS result_seq FROM {_CALLS} c LEFT JOIN {_RESULTS} r ON r.conv_id = c.conv_id AND r.call_id = c.call_id AND r.seq > c.seq GROUP BY ALL")
def tool_pairs(spark, sf_dir):
    return Z.tool_pairs(calls(spark, sf_dir), results(spark, sf_dir))


@query(f"SELECT conv_id, call_id, seq FROM {_RESULTS} r WHERE NOT EXISTS (SELECT 1 FROM {_CALLS} c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)")
def orphan_results(spark, sf_dir):
    return Z.orphan_results(results(spark, sf_dir), calls(spark, sf_dir))


@query("SELECT event_type AS type, user_id AS session, count(*) AS n FROM events GROUP BY ALL")
def event_counts(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("type"), F.col("user_id").alias("session")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH recent AS (SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events) WHERE place <= 8),
    seen AS (SELECT event_type, event_id, first FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS place, min(event_id) OVER (PARTITION BY event_type) AS first FROM events) WHERE place <= 500)
    SELECT u.user_id AS request_id, f.agent FROM (SELECT DISTINCT user_id FROM events) u
    LEFT JOIN (SELECT user_id, min_by(event_type, first) AS agent FROM recent JOIN seen USING (event_id) GROUP BY user_id) f USING (user_id)""")
def request_owner(spark, sf_dir):
    """Users' requests, found in the logs of agents named after event types, which come in the order of their first events."""
    rows = events(spark, sf_dir)
    requests = rows.select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("message_id"))
    return Z.owner(requests, rows.select(F.col("event_type").alias("agent"), F.col("event_id").alias("seq"), F.col("event_id").alias("message_id")))


def log(spark, sf_dir) -> DataFrame:
    """Events as a session log: errors replace the three events before them, or one if their end is unknown."""
    replaces = F.col("event_type") == "error"
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = events(spark, sf_dir).withColumn("seq", place.cast("long"))
    role = F.when(F.col("event_type") == "view", "assistant").otherwise("user")
    return rows.select(
        F.col("user_id").alias("session"), "seq", F.col("event_type").alias("type"), role.alias("role"), F.when(F.col("value") < 10, "").otherwise(F.col("props")).alias("text"),
        F.when(replaces, "replace").otherwise("append").alias("op"), F.when(replaces, F.col("seq") - 3).alias("start"), F.when(replaces & (F.col("seq") % 2 == 0), F.col("seq") - 1).alias("end"),
    )


@query("""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
    f AS (SELECT DISTINCT user_id, 0::BIGINT AS seq, []::BIGINT[] AS surface FROM e
        UNION ALL
        SELECT user_id, seq, CASE WHEN event_type = 'error' AND a > 0 THEN list_concat(surface[1:a - 1], [seq], surface[greatest(a, b) + 1:]) ELSE list_append(surface, seq) END
        FROM (SELECT f.user_id, e.seq, event_type, surface, coalesce(list_position(surface, e.seq - 3), 0) AS a, CASE WHEN e.seq % 2 = 0 THEN coalesce(list_position(surface, e.seq - 1), 0) ELSE 0 END AS b
            FROM f JOIN e ON e.user_id = f.user_id AND e.seq = f.seq + 1)),
    last AS (SELECT * FROM f WHERE seq > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1),
    s AS (SELECT user_id, unnest(range(len(surface))) AS k, unnest(surface) AS seq FROM last)
    SELECT user_id AS session, (row_number() OVER (PARTITION BY user_id ORDER BY k) - 1)::INTEGER AS place, seq, event_type AS type, CASE WHEN event_type = 'view' THEN 'assistant' ELSE 'user' END AS role, CASE WHEN value < 10 THEN '' ELSE props END AS text
    FROM s JOIN e USING (user_id, seq) WHERE NOT (event_type = 'view' AND value < 10)""")
def surface_fold(spark, sf_dir):
    return Z.fold(log(spark, sf_dir))


def exchanges(spark, sf_dir) -> DataFrame:
    """Conversations whose turns 1, 4, 7, ... call a tool if they are an assistant's, and whose next turns hold a result: of
    that call, or in every fifth conversation of none."""
    block = lambda kind, id: F.from_json(F.to_json(F.array(F.struct(F.lit(kind).alias("type"), id.alias("id"), id.alias("tool_call_id")))), f"array<{BLOCK}>")
    step, own = F.col("seq") % 3, F.concat(F.lit("c"), F.col("seq").cast("string"))
    answered = F.when(F.col("conv_id") % 5 == 0, "none").otherwise(F.concat(F.lit("c"), (F.col("seq") - 1).cast("string")))
    content = F.when((step == 1) & (F.col("role") == "assistant"), F.concat("content", block("tool-call", own))).when(step == 2, F.concat("content", block("tool-result", answered))).otherwise(F.col("content"))
    return messages(spark, sf_dir).withColumn("content", content)


_SAFE = "lambda k: NOT (results[k + 1] OR calls[k])"
_END = f"coalesce(list_max(list_filter(range(start + 1, wanted + 1), {_SAFE})), list_min(list_filter(range(wanted + 1, n), {_SAFE})), start)"


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, list(turn % 3 = 1 AND role = 'assistant' ORDER BY turn) AS calls, list(turn % 3 = 2 ORDER BY turn) AS results, count(*) AS n FROM conversations GROUP BY conv_id),
    b AS (SELECT conv_id, 0::BIGINT AS start, wanted, {_END.replace("start", "0")} AS stop FROM (SELECT *, least({PLAIN.prune_batch_size}, n - 1) AS wanted FROM t WHERE n > 1)
        UNION ALL
        SELECT conv_id, start, wanted, {_END} FROM (SELECT t.*, stop AS start, least(stop + {PLAIN.prune_batch_size}, n - 1) AS wanted FROM b JOIN t USING (conv_id) WHERE stop > start AND stop < n - 1))
    SELECT conv_id, start::INTEGER AS start, wanted::INTEGER AS wanted, stop::INTEGER AS "end" FROM b""")
def boundary_guard(spark, sf_dir):
    """All batches of each conversation, none of which parts a call from its result."""
    return Z.boundaries(exchanges(spark, sf_dir), PLAIN)


@query("""SELECT conv_id, turn AS seq, CASE WHEN conv_id % 5 = 0 THEN 'none' ELSE 'c' || (turn - 1) END AS call_id, coalesce(before = 'assistant' AND conv_id % 5 <> 0, FALSE) AS valid
    FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE turn % 3 = 2 AND role = 'user'""")
def result_order(spark, sf_dir):
    """Tool results, and whether each follows its call."""
    return Z.wire_order(exchanges(spark, sf_dir))


@query("""SELECT conv_id, length(wire) AS n_chars, md5(wire) AS digest FROM (SELECT conv_id, 'SYS:' || coalesce(max(CASE WHEN role = 'system' THEN text END), '') || CASE WHEN conv_id % 2 = 0 THEN chr(10) || 'TOOLS:[{"name":"' || conv_id || '"}]' ELSE '' END
    || coalesce(chr(10) || string_agg(role || '{t:' || text || CASE WHEN turn % 3 = 1 AND role = 'assistant' THEN '|a:{}' ELSE '' END || '}', chr(10) ORDER BY turn) FILTER (WHERE role <> 'system'), '') AS wire FROM conversations GROUP BY conv_id)""")
def request_wire(spark, sf_dir):
    """What a provider's prefix cache sees of each request, with line feeds for the separators."""
    rows = messages(spark, sf_dir)
    tools = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('[{"name":"'), F.col("conv_id").cast("string"), F.lit('"}]'))).otherwise("[]")
    system = F.max(F.when(F.col("role") == "system", F.col("content")[0]["text"]))
    requests = rows.groupBy("conv_id").agg(system.alias("system")).withColumn("tools_json", tools)
    called = exchanges(spark, sf_dir).withColumn("content", F.transform("content", lambda b: b.withField("arguments", F.when(b["type"] == "tool-call", "{}"))))
    wire = F.replace("wire", F.lit("\0"), F.lit("\n"))
    return Z.wire_text(called.filter("role <> 'system'"), requests).select("conv_id", F.length(wire).cast("long").alias("n_chars"), F.md5(wire.cast("binary")).alias("digest"))


@query("""WITH s AS (SELECT conv_id, turn, length(role) + length(text) + 2 AS size FROM conversations),
    t AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM s)
    SELECT conv_id, turn AS seq, floor((total - size) * 1000 / total + 0.5::DOUBLE) / 10 AS hit_percent FROM t WHERE total > size""")
def prefix_stability(spark, sf_dir):
    return Z.plain_stability(Z.wire_sizes(messages(spark, sf_dir)))


@query(W.stability(PLAIN))
def pruned_stability(spark, sf_dir):
    done = Z.pruned_stability(messages(spark, sf_dir), PrefixBackend(), PLAIN)
    return done.withColumns({c: F.round(c, 6) for c in ("mean_hit", "min_hit", "mean_interval")})
