"""Queries over documents: estimates, chunks, markers, distillation, results and files."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.config import EngineConfig
from brevia.functions.chunking import chunks_column, token_chunks_column, truncated_column
from brevia.functions.markers import DISTILL_CLOSE, PRUNE_CLOSE, PRUNE_PREFIX, distill_block_column, distill_line_column, mark_line, strip_prune_lines_column
from brevia.functions.text import content_hash, estimate_tokens, set_similarity, trigram_set, u16_len
from brevia.operators import distill as D
from brevia.operators import results as R
from brevia.operators import run as U
from brevia.operators.notices import mark_totals
from brevia.plans import foldsql as W
from brevia.plans import sqltext as S
from brevia.plans.registry import query
from brevia.sources.backends import ExtractiveBackend, PrefixBackend
from brevia.sources.cache import evict_half, evict_oldest
from brevia.sources.files import MAX_UNITS, PREAMBLE, files_block as build_block

CHUNK = 3000
WHOLE = EngineConfig(distill_chunk_chars=10_000_000)
CACHE_LIMIT = 400


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


@query(f"""SELECT lang, count(*) AS n_docs, sum({S.u16("text")})::BIGINT AS n_chars, sum({S.estimate("text")})::BIGINT AS n_tokens, max({S.estimate("text")}) AS most_tokens
    FROM documents GROUP BY lang""")
def doc_tokens(spark, sf_dir):
    docs = documents(spark, sf_dir).select("lang", u16_len(F.col("text")).alias("u"), estimate_tokens(F.col("text")).alias("t"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("u").alias("n_chars"), F.sum("t").alias("n_tokens"), F.max("t").alias("most_tokens"))


@query(f"""SELECT doc_id, (unnest(range(len(c))))::INTEGER AS pos, unnest(list_transform(c, lambda x: length(x)))::BIGINT AS n_chars, unnest(list_transform(c, lambda x: md5(x))) AS digest
    FROM (SELECT doc_id, {S.chunks("text", CHUNK)} AS c FROM documents)""")
def doc_chunks(spark, sf_dir):
    cut = documents(spark, sf_dir).select("doc_id", F.posexplode(chunks_column(F.col("text"), CHUNK)).alias("pos", "chunk"))
    return cut.select("doc_id", "pos", u16_len(F.col("chunk")).alias("n_chars"), md5(F.col("chunk")).alias("digest"))


@query(f"""SELECT id AS doc_id, (unnest(range(len(chunks))))::INTEGER AS pos, unnest(list_transform(chunks, lambda c: {S.estimate("c")})) AS n_tokens, unnest(list_transform(chunks, lambda c: md5(c))) AS digest
    FROM {W.token_chunks("SELECT doc_id AS id, text AS t, 500 AS budget FROM documents")}""")
def token_chunks(spark, sf_dir):
    cut = documents(spark, sf_dir).select("doc_id", F.posexplode(token_chunks_column(F.col("text"), 500)).alias("pos", "chunk"))
    return cut.select("doc_id", "pos", estimate_tokens(F.col("chunk")).alias("n_tokens"), md5(F.col("chunk")).alias("digest"))


@query(f"""SELECT id AS doc_id, truncated, original_tokens, {S.estimate("content")} AS n_tokens, md5(content) AS digest FROM {W.truncated("SELECT doc_id AS id, text AS t, 400 AS budget FROM documents")}""")
def truncate_docs(spark, sf_dir):
    done = documents(spark, sf_dir).select("doc_id", truncated_column(F.col("text"), 400).alias("x"))
    return done.select("doc_id", "x.truncated", "x.original_tokens", estimate_tokens(F.col("x.content")).alias("n_tokens"), md5(F.col("x.content")).alias("digest"))


@query(f"""WITH d AS (SELECT doc_id, left(text, 1500) AS head FROM documents), s AS (SELECT doc_id, {W.GRAMS.format("head")} AS g FROM d)
    SELECT a.doc_id, CASE WHEN len(a.g) + len(b.g) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))), 6) END AS likeness
    FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""")
def doc_similarity(spark, sf_dir):
    """Each document and the one with the next id."""
    sets = documents(spark, sf_dir).select("doc_id", trigram_set(F.col("text")).alias("g"))
    following = sets.select((F.col("doc_id") - 1).alias("doc_id"), F.col("g").alias("h"))
    return sets.join(following, "doc_id").select("doc_id", F.round(set_similarity(F.col("g"), F.col("h")), 6).alias("likeness"))


def _summary(share: float) -> Column:
    return F.substring(F.col("text"), F.lit(1), F.ceil(F.length("text") * F.lit(share)).cast("int"))


def _marks(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("short", _summary(0.4))
    sized = docs.select("doc_id", "lang", u16_len(F.col("text")).alias("chars"), estimate_tokens(F.col("text")).alias("before"), estimate_tokens(F.col("short")).alias("after"), "short")
    return sized.withColumn("block", distill_block_column(F.col("chars"), F.col("before"), F.col("after"), F.col("short")))


_MARKED = f"""(SELECT doc_id, lang, {S.u16("text")} AS chars, {S.estimate("text")} AS before, {S.estimate(S.prefix("text", 0.4))} AS after, {S.prefix("text", 0.4)} AS short FROM documents)"""


@query(f"""SELECT doc_id, {S.distill_line("chars", "before", "after")} AS mark, md5({S.distill_line("chars", "before", "after")} || chr(10) || short || chr(10) || '{DISTILL_CLOSE}') AS block_digest FROM {_MARKED}""")
def marker_encode(spark, sf_dir):
    return _marks(spark, sf_dir).select("doc_id", distill_line_column(F.col("chars"), F.col("before"), F.col("after")).alias("mark"), md5(F.col("block")).alias("block_digest"))


@query(f"""SELECT lang, count(*) AS n_marks, count(*) AS n_parsed, sum(chars)::BIGINT AS chars, sum(before)::BIGINT AS before, sum(after)::BIGINT AS after, {S.saved("sum(before)", "sum(after)")} AS percent
    FROM {_MARKED} GROUP BY lang""")
def marker_stats(spark, sf_dir):
    """Statistics read back from the blocks' text alone."""
    lines = _marks(spark, sf_dir).select("lang", mark_line(F.col("block")).alias("mark"))
    return mark_totals(lines, "lang").select("lang", "n_marks", "n_parsed", "chars", "before", "after", "percent")


@query(f"""SELECT doc_id, md5(array_to_string(list_filter(string_split('{PRUNE_PREFIX}·x⟧' || chr(10) || text || chr(10) || '{PRUNE_CLOSE}', chr(10)),
    lambda l: NOT starts_with(l, '{PRUNE_PREFIX}') AND l <> '{PRUNE_CLOSE}'), chr(10))) AS digest FROM documents""")
def strip_markers(spark, sf_dir):
    block = F.concat(F.lit(f"{PRUNE_PREFIX}·x⟧\n"), F.col("text"), F.lit(f"\n{PRUNE_CLOSE}"))
    return documents(spark, sf_dir).select("doc_id", md5(strip_prune_lines_column(block)).alias("digest"))


_SHARE = "CASE doc_id % 4 WHEN 0 THEN 0.4 WHEN 1 THEN 0.03 WHEN 2 THEN 1.0 ELSE 0.015 END::DOUBLE"


@query(f"""WITH a AS (SELECT doc_id, length(text) AS m, length({S.trimmed(f"left(text, ceil(length(text) * {_SHARE})::BIGINT)")}) AS n FROM documents)
    SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN n >= m THEN 'echo' WHEN n < 0.05::DOUBLE * m THEN 'too_short' ELSE 'ok' END AS chunk_verdict,
        CASE WHEN n = 0 THEN 'empty' WHEN n >= m THEN 'echo' WHEN n < least(80.0::DOUBLE, 0.02::DOUBLE * m) THEN 'too_short' ELSE 'ok' END AS history_verdict FROM a""")
def fidelity_check(spark, sf_dir):
    share = F.element_at(F.array(*(F.lit(x) for x in (0.4, 0.03, 1.0, 0.015))), (F.col("doc_id") % 4 + 1).cast("int"))
    answer = F.substring(F.col("text"), F.lit(1), F.ceil(F.length("text") * share).cast("int"))
    chunk, history = D.fidelity(F.col("text"), answer)
    return documents(spark, sf_dir).select("doc_id", chunk.alias("chunk_verdict"), history.alias("history_verdict"))


@query(f"""SELECT doc_id, {S.fnv1a("text")} AS seed, greatest(256, ceil({S.u16("text")} * 0.4::DOUBLE)::BIGINT) AS num_predict, 40 AS target_percent FROM documents""")
def distill_plan(spark, sf_dir):
    return D.call_plan(documents(spark, sf_dir), EngineConfig()).select("doc_id", "seed", "num_predict", "target_percent")


@query(f"""WITH x AS (SELECT d.*, pieces, error, {S.u16("text")} < 2000 AS passed, array_to_string(pieces, {W.BREAK}) AS short, {S.estimate("text")} AS before
        FROM documents d JOIN {W.distilled("SELECT doc_id AS id, text AS t FROM documents", CHUNK, W.extract_answer(0.4))} f ON f.id = d.doc_id)
    SELECT doc_id, CASE WHEN passed THEN 'passed' WHEN error IS NOT NULL THEN 'failed' WHEN pieces IS NULL THEN 'unchanged' ELSE 'distilled' END AS status, CASE WHEN NOT passed THEN before END AS before_tokens,
        CASE WHEN passed THEN NULL WHEN pieces IS NULL THEN before ELSE {S.estimate("short")} END AS after_tokens,
        md5(CASE WHEN passed OR pieces IS NULL THEN text ELSE {S.distill_line(S.u16("text"), "before", S.estimate("short"))} || chr(10) || short || chr(10) || '{DISTILL_CLOSE}' END) AS digest FROM x""")
def distill_documents(spark, sf_dir):
    """The default settings with a backend that keeps lines with facts."""
    done = D.distill(documents(spark, sf_dir), ExtractiveBackend(), EngineConfig(distill_chunk_chars=CHUNK))
    return done.select("doc_id", "status", "before_tokens", "after_tokens", md5(F.col("content")).alias("digest"))


_DISTILLED = f"""WITH d AS (SELECT *, {S.trimmed(S.prefix("text", 0.4))} AS short FROM documents),
    s AS (SELECT *, CASE WHEN {S.u16("text")} < 2000 THEN 'passed' WHEN short = '' OR length(short) < 0.05::DOUBLE * length(text) THEN 'failed' ELSE 'distilled' END AS status,
        {S.estimate("text")} AS before, {S.estimate("short")} AS after FROM d)"""


@query(f"""{_DISTILLED} SELECT doc_id, status, CASE WHEN status <> 'passed' THEN before END AS before_tokens, CASE status WHEN 'distilled' THEN after WHEN 'failed' THEN before END AS after_tokens,
    md5(CASE WHEN status = 'distilled' THEN {S.distill_line(S.u16("text"), "before", "after")} || chr(10) || short || chr(10) || '{DISTILL_CLOSE}' ELSE text END) AS digest FROM s""")
def distill_single(spark, sf_dir):
    """Texts as one chunk each, with a backend that SQL can express."""
    done = D.distill(documents(spark, sf_dir), PrefixBackend(), WHOLE)
    return done.select("doc_id", "status", "before_tokens", "after_tokens", md5(F.col("content")).alias("digest"))


@query(f"""{_DISTILLED}, known AS (SELECT DISTINCT text FROM documents WHERE source < 'src15')
    SELECT doc_id, CASE WHEN s.status = 'passed' THEN 'passed' WHEN k.text IS NOT NULL THEN 'cached' ELSE s.status END AS status,
        md5(CASE WHEN s.status = 'passed' THEN s.text WHEN k.text IS NOT NULL THEN 'known ' || md5(s.text) WHEN s.status = 'distilled'
            THEN {S.distill_line(S.u16("s.text"), "before", "after")} || chr(10) || short || chr(10) || '{DISTILL_CLOSE}' ELSE s.text END) AS digest
    FROM s LEFT JOIN known k ON s.text = k.text""")
def distill_dedup(spark, sf_dir):
    """With a cache that holds the texts of some sources."""
    docs = documents(spark, sf_dir)
    known = docs.filter("source < 'src15'").select("text").distinct()
    cache = known.select(D.content_key(F.col("text"), WHOLE).alias("content_hash"), F.concat(F.lit("known "), md5(F.col("text"))).alias("content"))
    return D.distill(docs, PrefixBackend(), WHOLE, cache=cache).select("doc_id", "status", md5(F.col("content")).alias("digest"))


@query(f"""SELECT id AS doc_id, n_parts::INTEGER AS n_chunks, len(pieces)::INTEGER AS n_kept, md5(array_to_string(pieces, {W.BREAK})) AS digest, error FROM {W.distilled("SELECT doc_id AS id, text AS t FROM documents", 200, W.prefix_answer(0.5))}""")
def chunk_dedup(spark, sf_dir):
    """Chunks and the summaries that are left once near repetitions are dropped; null where no chunk got shorter."""
    config = EngineConfig(distill_chunk_chars=200, distill_min_chars=0)

    @F.arrow_udf("struct<n_chunks:int,n_kept:int,digest:string,error:string>")
    def count(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            pieces = error = None
            try:
                pieces = D.distill_pieces(text or "", PrefixBackend(0.5), config)
            except D.BackendError as found:
                error = str(found)
            rows.append((len(D.chunk_text(text or "", 200)), pieces and len(pieces), pieces and hashlib.md5("\n\n".join(pieces).encode()).hexdigest(), error))
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["n_chunks", "n_kept", "digest", "error"])

    return documents(spark, sf_dir).select("doc_id", count(F.col("text")).alias("x")).select("doc_id", "x.*")


@query(f"""SELECT doc_id, {S.u16("text")} AS original_chars, {S.estimate("text")} AS before_tokens, {S.estimate("content")} AS after_tokens,
        {S.saved(S.estimate("text"), S.estimate("content"))} AS savings_percent, status = 'passed' AS skipped
    FROM ({_DISTILLED} SELECT doc_id, text, status, CASE WHEN status = 'distilled' THEN {S.distill_line(S.u16("text"), "before", "after")} || chr(10) || short || chr(10) || '{DISTILL_CLOSE}' ELSE text END AS content FROM s)""")
def distill_report(spark, sf_dir):
    done = U.distill_any(documents(spark, sf_dir), PrefixBackend(), WHOLE)
    return done.select("doc_id", "original_chars", "before_tokens", "after_tokens", "savings_percent", "skipped")


# --- documents as tool results ---------------------------------------------------------------------------


def _results(spark, sf_dir) -> DataFrame:
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    text, doc = block("text", F.col("text")), F.col("doc_id")
    tool = F.element_at(F.array(*(F.lit(x) for x in ("read", "search", "local_model_run", "shell"))), (doc % 4 + 1).cast("int"))
    content = F.when(doc % 6 == 0, F.array(text, block("image", F.lit(None).cast("string")))).when(doc % 6 == 1, F.array(text, text)).otherwise(F.array(text))
    return documents(spark, sf_dir).select(
        doc.alias("exec_id"), tool.alias("tool_name"), (doc % 5 == 0).alias("is_nested"), F.when(doc % 7 == 0, "block").otherwise("accept").alias("decision_kind"), (doc % 11 == 0).alias("has_value"), content.alias("content")
    )


@query(f"""WITH r AS (SELECT *, {S.u16("text")} * CASE WHEN doc_id % 6 = 1 THEN 2 ELSE 1 END AS total FROM documents)
    SELECT doc_id AS exec_id, total::BIGINT AS total_chars,
        doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 5 <> 0 AND doc_id % 4 <> 2 AND doc_id % 6 <> 0 AND total >= 2000 AS admitted,
        CASE WHEN {S.u16("text")} >= 2000 THEN CASE WHEN doc_id % 6 = 1 THEN 2 ELSE 1 END ELSE 0 END AS n_gated FROM r""")
def result_admission(spark, sf_dir):
    gated = F.size(F.filter(R.block_gate(EngineConfig()), lambda x: x))
    return _results(spark, sf_dir).select("exec_id", R.total_units(F.col("content")).alias("total_chars"), R.admitted(EngineConfig()).alias("admitted"), gated.alias("n_gated"))


@query("""SELECT doc_id, substring(sha256(text), 1, 16) AS text_hash, min(doc_id) OVER (PARTITION BY text) AS first_at, min(doc_id) OVER (PARTITION BY text) < doc_id AS reused FROM documents""")
def result_reuse(spark, sf_dir):
    found = R.first_written(documents(spark, sf_dir).select("doc_id", "text"), "text", "doc_id")
    return found.select("doc_id", "text_hash", "first_at", (F.col("first_at") < F.col("doc_id")).alias("reused"))


_RESULT = f"CASE WHEN status = 'distilled' AND admitted THEN {S.distill_line(S.u16('text'), 'before', 'after')} || chr(10) || short || chr(10) || '{DISTILL_CLOSE}' ELSE text END"


@query(f"""{_DISTILLED}, a AS (SELECT *, doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 5 <> 0 AND doc_id % 4 <> 2 AND doc_id % 6 <> 0
        AND {S.u16("text")} * CASE WHEN doc_id % 6 = 1 THEN 2 ELSE 1 END >= 2000 AS admitted FROM s)
    SELECT doc_id AS exec_id, status = 'distilled' AND admitted AS changed,
        md5({_RESULT} || CASE doc_id % 6 WHEN 0 THEN chr(10) WHEN 1 THEN chr(10) || {_RESULT} ELSE '' END) AS digest FROM a""")
def distill_results(spark, sf_dir):
    done = R.distill_results(_results(spark, sf_dir), PrefixBackend(), WHOLE)
    return done.select("exec_id", "changed", md5(F.array_join(F.transform("content", lambda b: F.coalesce(b["text"], F.lit(""))), "\n")).alias("digest"))


@query(f"""WITH f AS (SELECT substring(sha256(text), 1, 16) AS h, min(doc_id) AS first FROM documents GROUP BY 1)
    SELECT h AS content_hash, first AS inserted FROM f ORDER BY first DESC LIMIT {CACHE_LIMIT}""")
def cache_evict(spark, sf_dir):
    entries = documents(spark, sf_dir).select(content_hash(F.col("text")).alias("content_hash"), F.col("doc_id").alias("inserted"))
    return evict_oldest(entries, CACHE_LIMIT)


@query(f"""WITH f AS (SELECT substring(sha256(text), 1, 16) AS h, min(doc_id) AS first FROM documents GROUP BY 1),
    n AS (SELECT *, row_number() OVER (ORDER BY first DESC) AS place, count(*) OVER () AS n FROM f)
    SELECT h AS content_hash, first AS inserted FROM n WHERE n <= {CACHE_LIMIT} OR place <= {CACHE_LIMIT // 2 + 1} + (n - {CACHE_LIMIT + 1}) % {CACHE_LIMIT // 2}""")
def cache_evict_half(spark, sf_dir):
    entries = documents(spark, sf_dir).select(content_hash(F.col("text")).alias("content_hash"), F.col("doc_id").alias("inserted"))
    return evict_half(entries, CACHE_LIMIT)


# --- documents as files ----------------------------------------------------------------------------------

_CAPPED = f"CASE WHEN length(text) > {MAX_UNITS} THEN left(text, {MAX_UNITS}) || chr(10) || '… [shortened, ' || (length(text) - {MAX_UNITS}) || ' characters left out] …' ELSE text END"
_BLOCKS = f"""SELECT request, count(*)::INTEGER AS n_files, '{PREAMBLE.rstrip()}' || chr(10) || chr(10) || string_agg('===== FILE ' || place || '/' || n || ': ' || path || ' =====' || chr(10) || content, chr(10) || chr(10) ORDER BY path) AS block
    FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY path) AS place, count(*) OVER (PARTITION BY request) AS n FROM (
        SELECT doc_id // 3 AS request, lpad(doc_id::VARCHAR, 12, '0') || '.txt' AS path, {_CAPPED} AS content FROM documents)) GROUP BY request"""


def _blocks(spark, sf_dir) -> DataFrame:
    """Three documents to a request, as files."""
    path = F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt"))
    return build_block(documents(spark, sf_dir).select(F.expr("doc_id div 3").alias("request"), path.alias("path"), F.col("text").alias("content")), ["request"], order="path")


@query(f"SELECT request, n_files, length(block)::INTEGER AS n_chars, md5(block) AS digest FROM ({_BLOCKS})")
def files_block(spark, sf_dir):
    return _blocks(spark, sf_dir).select("request", "n_files", F.length("block").alias("n_chars"), md5(F.col("block")).alias("digest"))


INSTRUCTIONS = ("Summarise the files", "Translate each line", "Which file is longest?", "extract all dates", "请总结要点", "Make a digest", "逐条翻译", "count the words")


def _tasks(spark, sf_dir) -> DataFrame:
    told = F.element_at(F.array(*map(F.lit, INSTRUCTIONS)), (F.col("request") % len(INSTRUCTIONS) + 1).cast("int"))
    return _blocks(spark, sf_dir).select("request", F.col("block").alias("content"), told.alias("instruction"))


_LIST = "[" + ", ".join(f"'{x}'" for x in INSTRUCTIONS) + "]"
_AUTO = f"CASE WHEN regexp_matches(instruction, '(?i)({U.SUMMARY_WORDS})') THEN 'distill' WHEN regexp_matches(instruction, '(?i)({U.ITEM_WORDS})') THEN 'chunk' ELSE 'truncate' END"
TASKS = EngineConfig(run_max_context_tokens=2000)


@query(f"""WITH t AS (SELECT request, block, {_LIST}[request % {len(INSTRUCTIONS)} + 1] AS instruction FROM ({_BLOCKS})),
    p AS (SELECT *, {S.estimate("block")} AS content_tokens, greatest(1, 2000 - {S.estimate("instruction")} - 180) AS room FROM t)
    SELECT request, content_tokens, room, greatest(500, floor(room * 0.8::DOUBLE)::BIGINT) AS chunk_budget, CASE WHEN content_tokens <= room THEN 'full' ELSE {_AUTO} END AS strategy FROM p""")
def run_plan(spark, sf_dir):
    return U.plan(_tasks(spark, sf_dir), TASKS).select("request", "content_tokens", "room", "chunk_budget", "strategy")


@query(f"SELECT doc_id, {_AUTO} AS strategy FROM (SELECT doc_id, {_LIST}[doc_id % {len(INSTRUCTIONS)} + 1] || ' ' || text AS instruction FROM documents)")
def auto_strategy(spark, sf_dir):
    """Documents as instructions."""
    told = F.concat(F.element_at(F.array(*map(F.lit, INSTRUCTIONS)), (F.col("doc_id") % len(INSTRUCTIONS) + 1).cast("int")), F.lit(" "), F.col("text"))
    return documents(spark, sf_dir).select("doc_id", U.auto_strategy(told).alias("strategy"))


_SHARE_OF_FILE = 0.3
_RUN = f"""WITH t AS (SELECT request, block, {_LIST}[request % {len(INSTRUCTIONS)} + 1] AS instruction FROM ({_BLOCKS})),
    p AS (SELECT *, {S.estimate("block")} AS content_tokens, greatest(1, 2000 - {S.estimate("instruction")} - 180) AS room FROM t),
    q AS (SELECT *, greatest(500, floor(room * 0.8::DOUBLE)::BIGINT) AS chunk_budget, CASE WHEN content_tokens <= room THEN 'full' ELSE {_AUTO} END AS strategy FROM p),
    d AS (SELECT id, coalesce(array_to_string(pieces, {W.BREAK}), block) AS short, f.error, room
        FROM {W.distilled("SELECT request AS id, block AS t FROM q WHERE strategy = 'distill'", 3000, W.prefix_answer(_SHARE_OF_FILE))} f JOIN q ON f.id = request),
    c AS (SELECT id, len(chunks) AS n, array_to_string(list_transform(chunks, lambda x: {S.prefix("x", _SHARE_OF_FILE)}), {W.quoted(U.PART_BREAK)}) AS parts
        FROM {W.token_chunks("SELECT request AS id, block AS t, chunk_budget AS budget FROM q WHERE strategy = 'chunk'")}),
    a AS (SELECT request AS id, block AS content, NULL AS error FROM q WHERE strategy = 'full'
        UNION ALL SELECT id, content, NULL FROM {W.truncated("SELECT request AS id, block AS t, room AS budget FROM q WHERE strategy = 'truncate'")}
        UNION ALL SELECT x.id, content, error FROM {W.truncated("SELECT id, short AS t, room AS budget FROM d")} x JOIN d ON d.id = x.id)
    SELECT id AS request, strategy, 1 AS n_parts, CASE WHEN error IS NULL THEN md5({S.prefix("content", _SHARE_OF_FILE)}) END AS digest, error FROM a JOIN q ON request = id
    UNION ALL SELECT id, 'chunk', n::INTEGER, md5(CASE WHEN n > 1 THEN {S.prefix("parts", _SHARE_OF_FILE)} ELSE parts END), NULL FROM c"""


@query(_RUN)
def run_files(spark, sf_dir):
    """The whole map-reduce over files."""
    done = U.run_over_files(_tasks(spark, sf_dir), PrefixBackend(_SHARE_OF_FILE), TASKS, "request")
    return done.select("request", "strategy", "n_parts", md5(F.col("answer")).alias("digest"), "error")
