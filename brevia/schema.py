"""Data model: messages with nested content blocks, requests and session events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INNER = "struct<type:string,text:string>"
#: Blocks nest two deep: a tool result holds plain blocks.
BLOCK = f"struct<type:string,text:string,id:string,name:string,arguments:string,tool_call_id:string,is_error:boolean,content:array<{INNER}>>"
SOURCE = "struct<kind:string,plugin:string,form:string,summary:string>"
MESSAGE = f"conv_id long, seq long, role string, content array<{BLOCK}>, source {SOURCE}"
REQUEST = "conv_id long, system string, tools_json string"
EVENT = "session long, seq long, type string, role string, text string, op string, start long, end long"


def text_block(text: Column) -> Column:
    return F.struct(
        F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast("string").alias(c) for c in ("id", "name", "arguments", "tool_call_id")),
        F.lit(None).cast("boolean").alias("is_error"), F.lit(None).cast(f"array<{INNER}>").alias("content"),
    )


def from_conversations(df: DataFrame) -> DataFrame:
    """Plain turns (conv_id, turn, role, text) as messages of one text block."""
    return df.select("conv_id", F.col("turn").alias("seq"), "role", F.array(text_block(F.col("text"))).alias("content"), F.lit(None).cast(SOURCE).alias("source"))
