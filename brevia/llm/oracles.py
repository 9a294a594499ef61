"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from brevia.llm import chat_format, source_mixing, url_filter, warc_fixity

SQL: dict[str, str] = {
    "op1_source_mixing": source_mixing.oracle(),
    "op4_url_filter": url_filter.oracle(),
    "op10_chat_format": chat_format.oracle(),
    "op5_warc_fixity": warc_fixity.oracle(),
}
