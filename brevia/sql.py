"""The engine's functions in SQL: after register(spark), spark.sql("SELECT estimate_tokens(text) FROM documents").

Functions that built-ins express are SQL functions, which the optimizer inlines; the others run in Arrow batches.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from brevia.functions import chunking, markers, text
from brevia.operators import distill, run

_UNITS = "octet_length(encode(t, 'UTF-16BE')) / 2"
_CJK = f"regexp_count(t, '{text.CJK}')"
_PERCENT = "CASE WHEN before > 0 THEN CAST(floor((1 - after / before) * 100 + 0.5D) AS BIGINT) ELSE 0 END"
_OPEN = markers.DISTILL_OPEN.replace("{0}", "', chars, '").replace("{1}", "', before, '").replace("{2}", "', after, '").replace("{3}", "', CASE WHEN savings_percent(before, after) >= 0 THEN '-' ELSE '+' END, abs(savings_percent(before, after)), '")

#: Name, parameters, type and body of the SQL functions, in an order in which each knows the ones it uses.
SQL = (
    ("utf16_length", "t STRING", "BIGINT", f"CAST({_UNITS} AS BIGINT)"),
    ("estimate_tokens", "t STRING", "BIGINT", f"greatest(1L, CAST(floor({_CJK} + {text.OTHER_WEIGHT}D * ({_UNITS} - {_CJK}) + 0.5D) AS BIGINT))"),
    ("calibrated_tokens", "t STRING, factor DOUBLE", "BIGINT", "CAST(floor(estimate_tokens(t) * factor + 0.5D) AS BIGINT)"),
    ("content_hash16", "t STRING", "STRING", "substring(sha2(t, 256), 1, 16)"),
    ("savings_percent", "before BIGINT, after BIGINT", "BIGINT", _PERCENT),
    ("distill_mark", "chars BIGINT, before BIGINT, after BIGINT", "STRING", f"concat('{_OPEN}')"),
    ("first_line", "t STRING", "STRING", "substring_index(t, '\\n', 1)"),
    ("read_distill_mark", "line STRING", "STRUCT<chars: BIGINT, before: BIGINT, after: BIGINT, percent: BIGINT>", "CASE WHEN line RLIKE r'{0}' THEN named_struct({1}) END".format(
        markers.DISTILL_LINE, ", ".join(f"'{n}', CAST(regexp_extract(line, r'{markers.DISTILL_LINE}', {k}) AS BIGINT)" for k, n in enumerate(("chars", "before", "after", "percent"), 1)))),
    ("is_marked", "t STRING", "BOOLEAN", f"startswith(t, '{markers.DISTILL_PREFIX}') OR startswith(t, '{markers.PRUNE_PREFIX}')"),
    ("auto_strategy", "instruction STRING", "STRING", f"CASE WHEN instruction RLIKE '(?i)({run.SUMMARY_WORDS})' THEN 'distill' WHEN instruction RLIKE r'(?i)({run.ITEM_WORDS})' THEN 'chunk' ELSE 'truncate' END"),
)


def _by_row(kind: pa.DataType, one):
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([None if row[0] is None else one(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], kind)

    return run


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known in the session; gives their names."""
    for name, parameters, kind, body in SQL:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    listed = pa.list_(pa.string())

    @F.arrow_udf("bigint")
    def fnv1a(t: pa.Array) -> pa.Array:
        return pa.array(text.fnv1a_all(t.to_pylist()), pa.int64())

    @F.arrow_udf("double")
    def trigram_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
        return _by_row(pa.float64(), lambda x, y: text.similarity(x, y or ""))(a, b)

    @F.arrow_udf("array<string>")
    def token_chunks(t: pa.Array, budget: pa.Array) -> pa.Array:
        return _by_row(listed, chunking.token_chunks)(t, budget)

    @F.arrow_udf("string")
    def truncate_text(t: pa.Array, budget: pa.Array) -> pa.Array:
        return _by_row(pa.string(), lambda x, n: chunking.truncate_head_tail(x, n)[0])(t, budget)

    @F.arrow_udf("string")
    def strip_prune_lines(t: pa.Array) -> pa.Array:
        return _by_row(pa.string(), markers.strip_prune_lines)(t)

    @F.arrow_udf("string")
    def chunk_verdict(source: pa.Array, answer: pa.Array) -> pa.Array:
        def one(source, answer):
            try:
                return "echo" if distill.accept_chunk(source, answer or "") == source else "ok"
            except distill.BackendError as error:
                return str(error)

        return _by_row(pa.string(), one)(source, answer)

    functions = {f.__name__: f for f in (fnv1a, trigram_similarity, token_chunks, truncate_text, strip_prune_lines, chunk_verdict)}
    for name, f in functions.items():
        spark.udf.register(name, f)
    spark.udtf.register("chunk_text", chunking.ChunkText)
    return [*(x[0] for x in SQL), *functions, "chunk_text"]
