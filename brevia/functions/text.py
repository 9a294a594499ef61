"""Lengths, token estimates, fingerprints and similarity, as columns and in plain Python.

Lengths count UTF-16 code units, token estimates tell CJK ideographs from the rest, and rounding is
half towards plus infinity. Columns are built-in functions; the one Arrow UDF is the 32-bit fingerprint,
which advances all texts of a batch together, one code unit a step.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Fixed values of the token estimate: ideograph blocks and the weight of any other code unit.
CJK = "[㐀-䶿一-鿿豈-﫿]"
OTHER_WEIGHT = 0.28
# Fixed values of the 32-bit FNV-1a hash.
FNV_START = 2166136261
FNV_PRIME = 16777619

SIMILARITY_UNITS = 1500
_cjk = re.compile(CJK)


# --- plain Python -----------------------------------------------------------------------------------


def u16(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text) + sum(c > "￿" for c in text) if not text.isascii() else len(text)


def u16_tail(text: str, units: int) -> str:
    """The end of text of at most so many units; no character is cut in two."""
    if text.isascii() or u16(text) == len(text):
        return text[-units:] if units > 0 else ""
    raw = text.encode("utf-16-le", "surrogatepass")
    at = max(0, len(raw) - 2 * units)
    if at < len(raw) and 0xDC <= raw[at + 1] <= 0xDF:
        at += 2
    return raw[at:].decode("utf-16-le", "surrogatepass")


def round_half_up(x: float) -> int:
    return math.floor(x + 0.5)


def estimate(text: str) -> int:
    """Estimated tokens of a text, 1 at least."""
    cjk = 0 if text.isascii() else len(_cjk.findall(text))
    return max(1, round_half_up(cjk + OTHER_WEIGHT * (u16(text) - cjk)))


def calibrated(text: str, factor: float) -> int:
    return round_half_up(estimate(text) * factor)


def fnv1a(text: str) -> int:
    """FNV-1a of one text; many together are faster by fnv1a_all()."""
    h = FNV_START
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
        h = (h ^ unit) * FNV_PRIME & 0xFFFFFFFF
    return h


def fnv1a_all(texts: list[str | None]) -> np.ndarray:
    """FNV-1a over the UTF-16 code units of every text (null: of the empty text)."""
    raw = [np.frombuffer((t or "").encode("utf-16-le", "surrogatepass"), np.uint16) for t in texts]
    out = np.full(len(raw), FNV_START, np.uint64)
    sizes = np.array([len(x) for x in raw], np.int64)
    order = np.argsort(-sizes, kind="stable")
    units = np.concatenate([*raw, np.empty(0, np.uint16)]).astype(np.uint64)
    starts = (np.cumsum(sizes) - sizes)[order]
    falling = sizes[order]
    h = out[order]
    live = len(order)
    for k in range(int(falling[0]) if live else 0):
        while live and falling[live - 1] <= k:
            live -= 1
        h[:live] = ((h[:live] ^ units[starts[:live] + k]) * np.uint64(FNV_PRIME)) & np.uint64(0xFFFFFFFF)
    out[order] = h
    return out


def base36(n: int) -> str:
    digits = ""
    while n or not digits:
        n, k = divmod(n, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[k] + digits
    return digits


def trigrams(text: str, units: int = SIMILARITY_UNITS) -> set[bytes]:
    raw = text.encode("utf-16-le", "surrogatepass")[: 2 * units]
    return {raw[k : k + 6] for k in range(0, len(raw) - 4, 2)}


def similarity(a: str, b: str) -> float:
    """Jaccard similarity of the trigrams at the texts' beginnings; two texts without any are alike."""
    x, y = trigrams(a), trigrams(b)
    return len(x & y) / len(x | y) if x or y else 1.0


# --- columns ----------------------------------------------------------------------------------------


def rounded(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def u16_len(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def u16_left(c: Column, most: int) -> Column:
    """A text's beginning of at most so many units; no character is cut in two."""
    raw = F.encode(c, "UTF-16BE")
    split = F.hex(F.substring(raw, 2 * most - 1, 1)).between("D8", "DB")
    return F.when(u16_len(c) <= most, c).otherwise(F.decode(F.substring(raw, F.lit(1), F.when(split, 2 * most - 2).otherwise(2 * most)), "UTF-16BE"))


def u16_right(c: Column, most: Column) -> Column:
    """A text's end of at most so many units; no character is cut in two."""
    raw, start = F.encode(c, "UTF-16BE"), 2 * (u16_len(c) - most) + 1
    split = F.hex(F.substring(raw, start.cast("int"), F.lit(1))).between("DC", "DF")
    begin = F.when(split, start + 2).otherwise(start).cast("int")
    return F.when(u16_len(c) <= most, c).otherwise(F.decode(F.substring(raw, begin, (2 * u16_len(c)).cast("int")), "UTF-16BE"))


def estimate_tokens(c: Column) -> Column:
    cjk = F.regexp_count(c, F.lit(CJK))
    return F.greatest(F.lit(1).cast("long"), rounded(cjk + F.lit(OTHER_WEIGHT) * (u16_len(c) - cjk)))


def calibrated_tokens(c: Column, factor: float) -> Column:
    return rounded(estimate_tokens(c) * F.lit(float(factor)))


@F.arrow_udf(LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """FNV-1a as a column of unsigned 32-bit values."""
    return pa.array(fnv1a_all(texts.to_pylist()).astype(np.int64))


def fingerprint36(c: Column) -> Column:
    return F.lower(F.conv(fingerprint(c).cast("string"), 10, 36))


def content_hash(c: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def first_line(c: Column) -> Column:
    return F.substring_index(c, "\n", 1)


def trigram_set(c: Column, units: int = SIMILARITY_UNITS) -> Column:
    """Distinct trigrams of code units at a text's beginning, each as the 48-bit number of its three units."""

    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        found = []
        for text in texts.to_pylist():
            unit = np.frombuffer((text or "").encode("utf-16-le", "surrogatepass")[: 2 * units], np.uint16).astype(np.int64)
            found.append(np.unique(unit[:-2] | unit[1:-1] << 16 | unit[2:] << 32) if len(unit) > 2 else unit[:0])
        ends = np.cumsum([0, *map(len, found)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*found, np.empty(0, np.int64)])))

    return run(c)


def set_similarity(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def savings_percent(before: Column, after: Column) -> Column:
    return F.when(before > 0, rounded((1 - after / before) * 100)).otherwise(0)
