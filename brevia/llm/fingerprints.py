"""Document fingerprints by improved consistent weighted sampling.

A document is a set of words (A-Z lower-cased) weighted by how often they occur. For each of SAMPLES
samples a word's hash gives r, c ~ Gamma(2, 1) and b ~ U(0, 1); with t = floor(ln(weight) / r + b) the
sample is the (word, t) of least ln c - r (t - b + 1). Two documents' samples collide with a
probability equal to the generalised Jaccard similarity of their weights (sum of minima over sum of
maxima), so the share of equal samples estimates it.

The random numbers depend on a word's hash and the sample's number alone: every task draws the same
ones, without a vocabulary to share. r and c come from quantile tables (2**16 and 2**20 steps). They
are drawn once per distinct (word, weight) of up to PAIRS (document, word) pairs, few rows at a time
so that they stay in the processor's cache; a document of more pairs is reduced in several parts. The
least value itself, of 32 bits, tells the (word, t) that it comes from, and a sample keeps a 16-bit
hash of it.

A document without words has its own fingerprint, all zero, which no other document shares a sample
with. Null is the empty text. Extra columns are left out. Rows are in order of key, descending, null
last, rows of one key by a hash of the text; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevia.llm.shared import tables
from brevia.llm.textkit import U, mix, prefix_hash, span_hash, word_spans

SAMPLES = 128
BLOCK = 1 << 20
PAIRS = 1 << 17
ROWS = 256


@functools.cache
def _quantiles(bits: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2**bits equal steps, from a fine grid of its distribution."""
    x = np.linspace(0, np.sqrt(40), 1 << 17) ** 2
    return np.interp((np.arange(1 << bits) + 0.5) / (1 << bits), -np.expm1(-x) - x * np.exp(-x), x)


@functools.cache
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    salts = mix(np.arange(1, SAMPLES + 1, dtype=U) * U(0xA24BAED4963EE407)) | U(1)
    return salts, _quantiles(16).astype(np.float32), np.log(_quantiles(20)).astype(np.float32)


def _samples(words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """words x SAMPLES: ln c - r (t - b + 1) as an unsigned number of the same order."""
    salts, gamma, log_gamma = _draws()
    out = np.empty((len(words), SAMPLES), np.uint32)
    logs = np.log(weights).astype(np.float32)
    for k in range(0, len(words), ROWS):
        x = words[k : k + ROWS, None] * salts
        x = (x ^ (x >> U(32))) * U(0x94D049BB133111EB)
        x ^= x >> U(32)
        low, high = x.view("<u4")[:, 0::2], x.view("<u4")[:, 1::2]
        r = gamma.take(high >> np.uint32(16))
        b = (high & np.uint32(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
        a = log_gamma.take(low >> np.uint32(12)) + r * (b - np.float32(1))
        more = np.flatnonzero(weights[k : k + ROWS] > 1)  # else t is 0
        if len(more):
            a[more] -= r[more] * np.floor(logs[k + more, None] / r[more] + b[more])
        bits = a.view(np.int32)
        out[k : k + ROWS] = (bits ^ (bits >> 31 | np.int32(-0x80000000))).view(np.uint32)
    return out


def signatures(texts: list[bytes]) -> np.ndarray:
    """n x SAMPLES of uint16; 0 only where a text has no word."""
    data = np.frombuffer(b"".join(texts).lower(), np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        return out
    words = span_hash(prefix_hash(data), starts, ends)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    _, at, weight = np.unique(words ^ mix(doc.astype(U) + U(1)), return_index=True, return_counts=True)
    order = np.argsort(doc[at], kind="stable")
    at, weight = at[order], weight[order]
    doc, words = doc[at], words[at]
    least = np.full((len(texts), SAMPLES), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(at), PAIRS):
        part = slice(k, k + PAIRS)
        _, one, which = np.unique(mix(words[part] + weight[part].astype(U) * U(0xC2B2AE3D27D4EB4F)), return_index=True, return_inverse=True)
        drawn = _samples(words[part][one], weight[part][one])
        edges = [0, *(np.flatnonzero(np.diff(doc[part])) + 1).tolist(), len(which)]
        for i, j in itertools.pairwise(edges):
            d = doc[k + i]
            np.minimum(least[d], drawn.take(which[i:j], axis=0).min(0), out=least[d])
    some = np.diff(first) > 0
    out[some] = np.maximum(least[some] * np.uint32(0x9E3779B1) >> np.uint32(16), 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples, by row."""
    return (a == b).mean(1)


def as_hex(signature: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in signature.astype(">u2")]


def edited(text: str, following: str) -> str:
    """text with its last third replaced by the beginning of following, of the same length or all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _literal(values: list, kind: str) -> Column:
    """An array of numbers that the optimizer makes one constant of."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _rank(values: list[int], x: Column) -> Column:
    """How many of values, which descend, are greater than x: a search among blocks, then in one of them."""
    size = max(1, math.isqrt(len(values)))
    blocks = [values[k : k + size] for k in range(0, len(values), size)]
    if not blocks:
        return F.lit(0)
    whole = F.size(F.filter(_literal([b[-1] for b in blocks], "array<bigint>"), lambda y: y > x))
    rest = F.get(_literal(blocks, "array<array<bigint>>"), whole)
    return F.least(whole * size + F.coalesce(F.size(F.filter(rest, lambda y: y > x)), F.lit(0)), F.lit(len(values)))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, copied, key, text) in partitions by bucket, each sorted, so that a row's successor follows it.

    Order: key descending, null last, then a hash of the text, then text. Buckets are ranges of that order
    at approximate quantiles of key, one to a partition; a key that spans several quantiles, or null, has as
    many buckets, by the hash. Only the bounds and each bucket's first key reach the driver. Rows with a
    bucket's first key are also sent, marked as copied, to the end of the bucket before (the first
    bucket's to the last), where the first of them counts, so that no row's successor is missing and
    nothing is sorted in one place.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / n for k in range(1, n)] or [0.5]
    found = docs.agg(F.percentile_approx(key, shares, 20 * n).alias("bounds"), F.count(F.lit(1)).alias("rows"), F.count(key).alias("keys")).first()
    bounds, times = np.unique(np.array(found.bounds or [], np.int64), return_counts=True)
    bounds, times = bounds[::-1].tolist(), times[::-1].tolist()
    before = [0, *np.cumsum(times).tolist()]  # buckets whose bounds are greater than the k-th; also the nulls' first
    nulls = -(-n * (found.rows - found.keys) // max(1, found.rows))
    order = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    share = order.cast("double") / F.lit(2.0**64) + 0.5
    above = _rank(bounds, F.col(key).cast("bigint"))
    inside = F.when(F.col(key) == F.get(_literal(bounds, "array<bigint>"), above), F.floor(share * F.get(_literal(times, "array<int>"), above))).otherwise(0)
    last = F.least(F.floor(share * nulls), F.lit(max(nulls - 1, 0))) + before[-1] + 1
    placed = F.get(_literal(before, "array<int>"), above) + F.coalesce(inside, F.lit(0))
    rows = docs.select(F.when(F.col(key).isNull(), last).otherwise(placed).cast("int").alias("bucket"), F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), order.alias("hash"))
    heads = dict(rows.groupBy("bucket").agg(F.max("key")).collect())
    present = sorted(heads)
    back = dict(zip(present, [present[-1], *present[:-1]], strict=True)) if present else {}
    size = max(present, default=0) + 1
    head_of = _literal([heads.get(k) for k in range(size)], "array<bigint>")
    back_of = _literal([back.get(k, 0) for k in range(size)], "array<int>")
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("copied"))
    there = F.struct(F.get(back_of, F.col("bucket")).alias("bucket"), F.lit(1).alias("copied"))
    is_head = F.col("key").eqNullSafe(F.get(head_of, F.col("bucket")))
    sent = rows.select(F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here))).alias("to"), "key", "text", "hash").select("to.bucket", "to.copied", "key", "text", "hash")
    dealt = sent.repartitionById(size, F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "copied", F.col("key").desc_nulls_last(), "hash", "text").select("bucket", "copied", "key", "text")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row its fingerprint, its edited text's, and its likeness to that and to the next row."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        """rows: consecutive (bucket, copied, key, text); all but the last row are followed by their successor."""
        own = [(a, b) for a, b in zip(range(len(rows) - 1), range(1, len(rows)), strict=True) if not rows[a][1]]
        if not own:
            return None
        changed = [edited(rows[a][3], rows[b][3]).encode() for a, b in own]
        later = dict(zip((a for a, _ in own), changed, strict=True))
        found = signatures([x for k, r in enumerate(rows) for x in (r[3].encode(), later.get(k, b""))])
        a, b = (np.array(x) for x in zip(*own, strict=True))
        mine, after, found = found[2 * a], found[2 * a + 1], found[0::2]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][2] for k in a], pa.int64()), pa.array([len(rows[k][3]) for k in a], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in changed]), pa.array(as_hex(mine)), pa.array(as_hex(after)),
                pa.array(likeness(mine, after)), pa.array(likeness(mine, found[b])),
            ],
            [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches):
        held: list[tuple] = []
        n = 0
        for batch in batches:
            columns = [batch.column(k) for k in range(3)]
            for k, words in enumerate(batch.column(3)):
                row = (*(c[k].as_py() for c in columns), words.as_py())
                if row[1] and held and held[-1][1]:
                    continue  # the first of the copied rows is the successor
                held.append(row)
                n += len(row[3])
                if n > BLOCK and len(held) > 1:
                    if (out := solve(held)) is not None:
                        yield out
                    held, n = [row], len(row[3])
        if (out := solve(held)) is not None:
            yield out

    schema = f"`{key}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, key, text).mapInArrow(run, schema)


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(tables(spark, sf_dir, "documents"))
