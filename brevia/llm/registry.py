"""Queries of the subpackage and their oracle SQL."""

from __future__ import annotations

from brevia.llm import oracles
from brevia.llm.chat_format import op10_chat_format
from brevia.llm.fingerprints import op7_fingerprints
from brevia.llm.quality_classifier import op6_quality_classifier
from brevia.llm.quality_rules import op3_quality_rules
from brevia.llm.sentencepiece_codec import op2_sentencepiece
from brevia.llm.simhash_dedup import op8_simhash_dedup
from brevia.llm.source_mixing import op1_source_mixing
from brevia.llm.token_output import op9_token_output
from brevia.llm.url_filter import op4_url_filter
from brevia.llm.warc_fixity import op5_warc_fixity

QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_rules": op3_quality_rules,
    "op4_url_filter": op4_url_filter,
    "op5_warc_fixity": op5_warc_fixity,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_fingerprints": op7_fingerprints,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_token_output": op9_token_output,
    "op10_chat_format": op10_chat_format,
}

ORACLES = {name: sql for name, sql in oracles.SQL.items() if name in QUERIES}
