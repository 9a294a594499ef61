"""Cutting long texts by length or by estimated tokens, on line ends where possible."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from brevia.functions.text import estimate, u16

TRUNCATED = "\n\n… [shortened to the budget: beginning and end are kept, the middle is left out] …\n\n"


def _units(text: str, size: int) -> tuple[str, str]:
    """text at a UTF-16 offset, moved back if that would cut a character in two."""
    if text.isascii() or u16(text) == len(text):
        return text[:size], text[size:]
    raw = text.encode("utf-16-le")
    if size > 1 and 0xDC <= (raw[2 * size + 1] if 2 * size < len(raw) else 0) <= 0xDF:
        size -= 1
    return raw[: 2 * size].decode("utf-16-le"), raw[2 * size :].decode("utf-16-le")


def chunk_text(text: str, most: int) -> list[str]:
    """Pieces of at most `most` units: whole lines as long as they fit together, an over-long line cut hard.

    The line break between two pieces is dropped, and so are empty lines at a piece's beginning.
    """
    if u16(text) <= most:
        return [text]
    out, held, size = [], [], 0  # held: lines of the piece being filled; its first isn't empty
    for line in text.split("\n"):
        n = u16(line)
        if held and size + 1 + n > most:
            out.append("\n".join(held))
            held, size = [], 0
        if held:
            held.append(line)
            size += 1 + n
            continue
        while n > most:
            part, line = _units(line, most)
            out.append(part)
            n = u16(line)
        if line:
            held, size = [line], n
    return [*out, "\n".join(held)] if held else out


def _longest_prefix(text: str, budget: int) -> int:
    """The most characters, 1 at least, whose estimate is within the budget: it never falls as a text grows."""
    low, high = 1, len(text)
    while low < high:
        middle = (low + high + 1) // 2
        if estimate(text[:middle]) <= budget:
            low = middle
        else:
            high = middle - 1
    return low


def token_chunks(text: str, budget: int) -> list[str]:
    """Pieces within a token budget; each line costs its estimate and one more, an over-long one is cut hard."""
    out, held, spent = [], [], 0
    for line in text.split("\n"):
        cost = estimate(line)
        if held and spent + cost + 1 > budget:
            out.append("\n".join(held))
            held, spent = [], 0
        if cost > budget:
            if held:
                out.append("\n".join(held))
                held, spent = [], 0
            while estimate(line) > budget:
                cut = _longest_prefix(line, budget)
                out.append(line[:cut])
                line = line[cut:]
            if line:
                out.append(line)
            continue
        if held or line:
            held.append(line)
        spent += cost + 1
    return [*out, "\n".join(held)] if held else out


def truncate_head_tail(text: str, budget: int) -> tuple[str, bool, int]:
    """(content, whether it was shortened, the whole text's estimate): three fifths of the budget for the
    beginning, the rest for as many whole lines of the end as fit, one at least."""
    whole = estimate(text)
    if whole <= budget:
        return text, False, whole
    for_head = max(1, budget * 6 // 10)
    head = next(iter(token_chunks(text, for_head)), "")
    tail: list[str] = []
    spent = 0
    for line in reversed(text.split("\n")):
        cost = estimate(line) + 1
        if tail and spent + cost > budget - for_head:
            break
        tail.append(line)
        spent += cost
    return head + TRUNCATED + "\n".join(reversed(tail)), True, whole


def _lists(kind: str, cut):
    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else cut(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run


def chunks_column(c: Column, most: int) -> Column:
    return _lists("array<string>", lambda t: chunk_text(t, most))(c)


def token_chunks_column(c: Column, budget: int) -> Column:
    return _lists("array<string>", lambda t: token_chunks(t, budget))(c)


def token_chunks_by(c: Column, budget: Column) -> Column:
    """token_chunks with a budget for each row."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array, budgets: pa.Array) -> pa.Array:
        return pa.array([None if t is None else token_chunks(t, b) for t, b in zip(texts.to_pylist(), budgets.to_pylist(), strict=True)], pa.list_(pa.string()))

    return run(c, budget)


def truncated_column(c: Column, budget: int) -> Column:
    @F.arrow_udf("struct<content:string,truncated:boolean,original_tokens:long>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [truncate_head_tail(t or "", budget) for t in texts.to_pylist()]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        kinds = (pa.string(), pa.bool_(), pa.int64())
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["content", "truncated", "original_tokens"])

    return run(c)


@udtf(returnType=StructType([StructField("pos", IntegerType()), StructField("chunk", StringType())]))
class ChunkText:
    """chunk_text as a table function, for LATERAL joins."""

    def eval(self, text: str, most: int):
        for k, part in enumerate(chunk_text(text or "", most)):
            yield k, part
