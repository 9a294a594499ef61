"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: the texts' A-Z are lower-cased, words are runs without 0x20 and 0x09-0x0D, and every
four-word shingle (space-joined, repeats included; a shorter text is one shingle) gives an XXH64
with seed 42. A bit of the fingerprint is 1 if more than half of the hashes have it; a text without
words (null and empty ones too) has fingerprint zero and is linked like any other.

Links: distinct fingerprints at radius 4 or less. The 64 bits are cut into radius + m blocks; two
fingerprints within the radius agree on m blocks at least, so a table for every choice of m blocks,
keyed by their bits, loses no link. m grows and keys widen with the number of fingerprints, which
keeps buckets near BUCKET rows. A bucket over TILE rows is cut into tiles by hash and every pair of
tiles is a unit of work of its own, so no task holds a large bucket.

In a unit the candidates' bits are stored as vertical planes, 64 candidates to a machine word. A block
of queries runs down the planes; full adders feed bit-sliced counters of all distances at once, and
cells (a query and a word of 64 candidates) are abandoned once all their distances exceed the radius.
A unit returns a spanning forest of the links that it finds, at most one link for each of its rows,
never all pairs of a tight group.

Near copies: texts whose sets of distinct five-word shingles have Jaccard similarity ALIKE (4/5) or more,
near_links(). Nothing is estimated: a pair is a link if its counted shingles say so, and none is missed.
Two such sets, each in one order of all shingles, share one among their first n - ceil(4n/5) + 1 (the
prefix), so rows that share a prefix shingle are candidates. Shingles that are frequent in a sample of
documents come last in that order, which changes cost only. Three bounds that no link exceeds thin them out:
the sizes, what is left behind the shared shingle, and the bits in which parities of the hashed shingles
differ (at most the size of the symmetric difference). A shingle with more than RUN_ROWS rows or DENSE
times as many pairs as rows gives a chain of its rows instead of pairs. Components of the candidates are cut
into tiles of GROUP sets, and every pair of tiles counts the shingles that each two of its sets share.
filter_documents() takes both kinds of links together, label() only those of the 64-bit fingerprints.

Repeated rows share a fingerprint and so a component; rows with one doc_id and different texts are
separate rows. A component's id is its smallest doc_id (null if none has one). Extra columns are
left out by label(), kept by filter_documents(). An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevia.llm.components import components
from brevia.llm.shared import cut, kept, map_arrow, probable, released, remove, spread_join, tables
from brevia.llm.textkit import mix, shingle_sets

RADIUS = 4
SHINGLE = 4
BUCKET = 1024
#: Near copies: the least similarity as a fraction, sets a tile, pairs a row of a shingle, documents
#: sampled for frequent shingles, how often one is there, how many are kept, words of a shingle and
#: rows of a shingle that are compared without a chain.
ALIKE = (4, 5)
GROUP = 512
DENSE = 16
SAMPLE = 20_000
FREQUENT = 4
MOST_FREQUENT = 100_000
NEAR_SHINGLE = 5
RUN_ROWS = 2048
TILE = 4096
ROWS = 256
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(raw: bytes) -> int:
    """The fingerprint of one UTF-8 text."""
    hashes = shingle_hashes(raw)
    if not len(hashes):
        return 0
    return int(_majority(hashes, np.array([0]), np.array([len(hashes)]))[0])


def shingle_hashes(raw: bytes) -> np.ndarray:
    """XXH64 of all SHINGLE-word shingles, in order. bytes.lower and bytes.split know ASCII only, as is wanted."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    return np.array([digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends[SHINGLE - 1 :].tolist(), strict=False)], np.uint64)


def _majority(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each run of hashes, the bits set in more than half."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


class _Prints:
    """Fingerprints of many documents: their hashes are held up to a bound and counted together."""

    def __init__(self, n: int, most: int):
        self.out, self.most = np.zeros(n, np.uint64), most
        self.held: list[np.ndarray] = []
        self.at: list[int] = []
        self.n = 0

    def add(self, k: int, hashes: np.ndarray) -> None:
        if len(hashes) > self.most:  # a very long text: counted in pieces
            pieces = (hashes[i : i + self.most].astype(">u8").view(np.uint8) for i in range(0, len(hashes), self.most))
            ones = sum(np.unpackbits(x).reshape(-1, 64).sum(0, dtype=np.int64) for x in pieces)
            self.out[k] = np.packbits(2 * ones > len(hashes)).view(">u8")[0]
        elif len(hashes):
            if self.n + len(hashes) > self.most:
                self.flush()
            self.held.append(hashes)
            self.at.append(k)
            self.n += len(hashes)

    def flush(self) -> np.ndarray:
        if self.at:
            sizes = np.array([len(x) for x in self.held])
            self.out[self.at] = _majority(np.concatenate(self.held), np.cumsum(sizes) - sizes, sizes)
            self.held, self.at, self.n = [], [], 0
        return self.out


def column_fingerprints(column: pa.Array, most: int = 1 << 16) -> np.ndarray:
    """Fingerprints of a binary column, whole texts. most bounds the hashes whose bits are held at once."""
    prints = _Prints(len(column), most)
    for k, raw in enumerate(column):
        prints.add(k, shingle_hashes(raw.as_py() or b""))
    return prints.flush()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", near: bool = False, hashed: bool = False) -> DataFrame:
    """(key, fp long: the fingerprint's 64 bits) of every row, if near or hashed txt: the text's hash, and if near (set:
    the hash of its set of shingles, n: how many, parity, prefix: the first ones in the order of rank())."""
    chosen = docs.select(F.col(key), F.col(text).cast("string").cast("binary").alias("text"))
    often = frequent(chosen) if near else None

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = column_fingerprints(batch.column(1))
            columns, names = [batch.column(0), pa.array(fp.view(np.int64))], [key, "fp"]
            if near or hashed:
                columns.append(batch.column(2))
                names.append("txt")
            if near:
                sets = list(shingle_sets(batch.column(1), NEAR_SHINGLE))
                n = np.array([len(x) for x in sets], np.int32)
                columns += [pa.array([set_hash(x) for x in sets], pa.int64()), pa.array(n)]
                columns.append(pa.array([parity(x) for x in sets], pa.list_(pa.int64())))
                columns.append(pa.array([rank(x, *often)[: prefix_length(len(x))].view(np.int64) for x in sets], pa.list_(pa.int64())))
                names += ["set", "n", "parity", "prefix"]
            return pa.RecordBatch.from_arrays(columns, names)

        return step

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, fp long"
    if near or hashed:
        chosen, schema = chosen.withColumn("txt", F.xxhash64("text")), f"{schema}, txt long"
    if near:
        schema += ", set long, n int, parity array<long>, prefix array<long>"
    return map_arrow(chosen, schema, make)


# --- sets of shingles -----------------------------------------------------------------------------


def set_hash(hashes: np.ndarray) -> int:
    """Of a set of shingles, in order."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 42)).view(np.int64)))


def prefix_length(n: int) -> int:
    """Sets of n shingles that are alike share one of so many first ones."""
    return n + (-ALIKE[0] * n // ALIKE[1]) + 1 if n else 0


def parity(hashes: np.ndarray) -> np.ndarray:
    """2 to 4 bits a hash, a power of two of words: of each bit, whether the hashes that fall on it are odd in number.
    Two sets' parities differ in at most as many bits as they have shingles that the other lacks; the xor of a
    parity's halves is that of half as many words."""
    bits = 64 << max(0, len(hashes) - 1 >> 5).bit_length()
    odd = np.bincount((mix(hashes) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def rank(hashes: np.ndarray, often: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sorted hashes in one order of all shingles: frequent ones last, else by hash."""
    if not len(often) or not len(hashes):
        return hashes
    at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
    return hashes[np.argsort(np.where(often[at] == hashes, times[at], 0), kind="stable")]


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several distinct texts of a sample share, sorted, and how many do."""
    share = min(1.0, SAMPLE / max(1, texts.count()))
    drawn = texts.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).distinct()

    def make():
        return lambda batch: pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(shingle_sets(batch.column(0), NEAR_SHINGLE))).view(np.int64))], ["h"]) if batch.num_rows else None

    found = map_arrow(drawn, "h long", make).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT)
    with released(texts.sparkSession):
        most = found.orderBy(F.col("n").desc(), "h").limit(MOST_FREQUENT)
    rows = most.toArrow()
    often, times = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(often)
    return often[order], times[order]


def run_pairs(n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of the rows that share a prefix shingle (sizes, in order, and its places): positions u, v of pairs that may be
    alike, and False; or, if there are too many, a chain that holds them, and True."""
    p, q = ALIKE
    if len(n) <= RUN_ROWS:
        us, vs, total = [], [], 0
        for a in range(len(n) - 1):
            end = int(np.searchsorted(n, q * n[a] // p, "right"))
            m, left = n[a + 1 : end], np.minimum(n[a] - at[a], n[a + 1 : end] - at[a + 1 : end])
            found = np.flatnonzero((p + q) * left >= p * (n[a] + m))
            us.append(np.full(len(found), a))
            vs.append(found + a + 1)
            total += len(found)
            if total > DENSE * len(n):
                break
        else:
            return np.concatenate([np.empty(0, np.int64), *us]), np.concatenate([np.empty(0, np.int64), *vs]), False
    u = np.flatnonzero(q * n[:-1] >= p * n[1:])
    return u, u + 1, True


def set_links(sets: list[np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one unit, as forest() gives them, by the number of shingles that each two sets share."""
    one = not side.any()
    n = np.array([len(x) for x in sets])
    doc = np.repeat(np.arange(len(sets)), n)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    doc, token = doc[shared[token]], (np.cumsum(shared) - 1)[token[shared[token]]]
    order = np.argsort(token, kind="stable")
    doc, token = doc[order], token[order]
    left, right = (np.arange(len(sets)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    both = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(token, [begin, begin + 4096])
        has = np.zeros((len(sets), min(4096, int(shared.sum()) - begin)), np.float32)
        has[doc[a:b], token[a:b] - begin] = 1
        both += has[left] @ has[right].T
    p, q = ALIKE
    u, v = np.nonzero((p + q) * both.astype(np.int64) >= p * (n[left][:, None] + n[right][None, :]))
    label = np.arange(len(sets))
    join_up(label, left[u], right[v])
    at = np.flatnonzero(label != np.arange(len(label)))
    return at, label[at]


# --- bit-sliced comparison ------------------------------------------------------------------------


def _planes(values: np.ndarray) -> np.ndarray:
    """bits x words of n x k fingerprints: bit p of candidate 64 * w + i is bit i of planes[p, w]. Lanes beyond
    the last are zero."""
    n = -(-len(values) // 64) * 64
    bits = np.unpackbits(np.ascontiguousarray(values.astype("<u8")).view(np.uint8), bitorder="little").reshape(len(values), -1)
    padded = np.zeros((bits.shape[1], n), np.uint8)
    padded[:, : len(values)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8").astype(np.uint64)


class _Counters:
    """Distances of all lanes as bit planes, lowest first, and over: lanes whose count passed what those hold."""

    def __init__(self, shape, radius: int):
        self.radius = radius
        self.planes = [np.zeros(shape, np.uint64) for _ in range(max(2, radius.bit_length()))]
        self.over = np.zeros(shape, np.uint64)

    def _ripple(self, carry: np.ndarray, level: int) -> None:
        for k in range(level, len(self.planes)):
            plane = self.planes[k]
            self.planes[k], carry = plane ^ carry, plane & carry
        self.over |= carry

    def add(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        """Three planes of differences: a full adder first, then one ripple for its sum and one for its carry."""
        ab = a ^ b
        self._ripple(ab ^ c, 0)
        self._ripple((a & b) | (ab & c), 1)

    def dead(self) -> np.ndarray:
        """Lanes over the radius: a comparison from the highest plane down."""
        more, equal = self.over.copy(), ~self.over
        for k in range(len(self.planes) - 1, -1, -1):
            if self.radius >> k & 1:
                equal = equal & self.planes[k]
            else:
                more |= equal & self.planes[k]
                equal = equal & ~self.planes[k]
        return more

    def keep(self, at) -> None:
        self.planes, self.over = [x[at] for x in self.planes], self.over[at]


def close_pairs(queries: np.ndarray, candidates: np.ndarray, radius: int = RADIUS, same: bool = False):
    """Yields (query, candidate) positions at radius or fewer differing bits, a block of queries at a time.

    queries, candidates: n x k words. same: both are one list; only pairs with query < candidate are given.
    """
    if not len(queries) or not len(candidates):
        return
    planes = _planes(candidates)
    bits, words = planes.shape
    lanes = np.full(words, ALL)
    if len(candidates) % 64:
        lanes[-1] = np.uint64((1 << len(candidates) % 64) - 1)
    none = np.zeros(1, np.uint64)
    # by then unrelated fingerprints, which differ in every other bit, are over the radius
    dense = next((p for p in range(3, bits, 3) if p / 2 - 1.6 * p**0.5 > radius), bits // 3 * 3)
    for begin in range(0, len(queries), ROWS):
        block = queries[begin : begin + ROWS]
        skip = begin // 64 if same else 0  # words whose candidates all come before these queries
        rows = (block[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        masks = np.where(rows.reshape(len(block), -1).T, ALL, np.uint64(0))
        count = _Counters((len(block), words - skip), radius)
        for p in range(0, dense, 3):
            count.add(*(planes[k, skip:][None, :] ^ masks[k][:, None] for k in range(p, p + 3)))
        row, word = np.nonzero(~count.dead() & lanes[skip:])
        count.keep((row, word))
        word = word + skip
        for p in range(dense, bits, 3):
            if not len(row):
                break
            count.add(*(planes[k, word] ^ masks[k, row] if k < bits else none for k in range(p, p + 3)))
            if (p - dense) % 12 == 9 or p + 3 >= bits:
                left = np.flatnonzero(~count.dead() & lanes[word])
                count.keep(left)
                row, word = row[left], word[left]
        if not len(row):
            continue
        alive = ~count.dead() & lanes[word]
        cell, lane = np.nonzero(np.unpackbits(alive.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64))
        q, c = row[cell] + begin, word[cell] * 64 + lane
        if same:
            later = q < c
            q, c = q[later], c[later]
        if len(q):
            yield q, c


def join_up(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Unites the sets of u[i] and v[i] in label, where each position points to its set's first position."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(step := label[label], label):
            label[:] = step


def forest(values: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links of one unit, as positions in values: side 0 and 1 are two tiles; where only one is present, the
    tile with itself."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    label = np.arange(len(values))
    if len(right):
        for q, c in close_pairs(values[left], values[right], radius):
            join_up(label, left[q], right[c])
    else:
        for q, c in close_pairs(values[left], values[left], radius, same=True):
            join_up(label, left[q], left[c])
    at = np.flatnonzero(label != np.arange(len(label)))
    return at, label[at]


# --- tables and units -----------------------------------------------------------------------------


def _masks(n: int) -> list[int]:
    """For n distinct fingerprints, the key mask of each table."""
    wanted = max(0, math.ceil(math.log2(max(n, 1) / BUCKET)))
    m = 1
    while 64 * m // (RADIUS + m) < wanted and m < 4:
        m += 1
    edges = [round(64 * k / (RADIUS + m)) for k in range(RADIUS + m + 1)]
    out = []
    for chosen in itertools.combinations(range(RADIUS + m), m):
        bits = [b for k in chosen for b in range(edges[k], edges[k + 1])]
        out.append(sum(1 << b for b in bits[:wanted]))
    return sorted(set(out))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, n: int) -> DataFrame:
    """(u, v): a spanning set of the links between n distinct fingerprints fp."""
    return _compared(distinct.select("fp"), [F.col("fp").bitwiseAND(_signed(x)) for x in _masks(n)], ["fp"], RADIUS)


def candidates(sets: DataFrame) -> DataFrame:
    """(u, v): links between rows of sets (set, n, parity, prefix) whose components hold all that are alike."""
    rows = sets.select(F.posexplode("prefix").alias("at", "token"), "set", "n").select("token", "n", "set", "at")
    dealt = rows.repartition("token").sortWithinPartitions("token", "n", "set")

    def make_runs(batches):
        for token, n, key, at in _whole_runs(batches, 1, 4):
            cuts = np.flatnonzero(token[1:] != token[:-1]) + 1
            edges = np.concatenate([[0], cuts, [len(token)]])
            us, vs, chains = [], [], []
            for a, b in zip(edges[:-1][np.diff(edges) > 1].tolist(), edges[1:][np.diff(edges) > 1].tolist(), strict=True):
                u, v, chain = run_pairs(n[a:b], at[a:b])
                us.append(key[a + u])
                vs.append(key[a + v])
                chains.append(np.full(len(u), chain))
            if sum(map(len, us)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, chains)], ["u", "v", "chain"])

    found = cut(dealt.mapInArrow(make_runs, "u long, v long, chain boolean").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("chain").alias("chain")), True)
    u, v = (sets.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}")) for x in "uv")
    half = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (x, y) -> x ^ y), {0})"
    pairs = found.filter(~F.col("chain")).join(u, "u").join(v, "v")
    apart = F.expr(f"aggregate(zip_with({half.format('pu', 'pv')}, {half.format('pv', 'pu')}, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)")
    p, q = ALIKE
    return found.filter("chain").select("u", "v").union(pairs.filter((p + q) * apart <= (q - p) * (F.col("nu") + F.col("nv"))).select("u", "v"))


def groups(sets: DataFrame) -> DataFrame:
    """(set, root): the rows of sets (set, n, parity, prefix; one each) that have candidates, and their component."""
    roots = components(candidates(sets))
    return cut(roots.select(F.col("node").alias("set"), "root").union(roots.select(F.col("root").alias("set"), "root").distinct()), True)


def near_links(docs: DataFrame, prints: DataFrame, members: DataFrame, text: str = "text") -> DataFrame:
    """(u, v): a spanning set of the links between the sets of members, groups() of docs. prints: (set, txt) of docs."""
    own = cut(prints.join(members, "set").groupBy("set", "root").agg(F.min("txt").alias("txt")), True)
    raw = F.col(text).cast("string").cast("binary")
    texts = probable(docs.select(F.xxhash64(raw).alias("txt"), raw.alias("text")), "txt", own.select("txt"))
    texts = texts.join(own, "txt").dropDuplicates(["set"]).select("set", "text")
    units = _units(members.select("set", F.lit(0).alias("tab"), F.col("root").alias("key")), ["set"], GROUP)
    dealt = units.join(texts, "set").select("key", "i", "j", "side", "set", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def make_units(batches):
        for *ids, side, key, raw in _whole_runs(batches, 3, 6):
            ids = np.stack(ids, 1)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            us, vs = [], []
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(ids)]):
                u, v = set_links(list(shingle_sets(pa.array(raw[a:b], pa.large_binary()), NEAR_SHINGLE)), side[a:b])
                us.append(key[a + u])
                vs.append(key[a + v])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return dealt.mapInArrow(make_units, "u long, v long")


def _whole_runs(batches, ids: int, width: int):
    """The columns of batches, cut so that rows with the same first ids columns, which follow each other, stay together."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)]
        if not len(cols[0]):
            continue
        last = np.ones(len(cols[0]), bool)
        for c in cols[:ids]:
            last &= c == c[-1]
        rest = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if held and (rest or any(held[-1][k][-1] != cols[k][0] for k in range(ids))):
            if rest:
                held.append([c[:rest] for c in cols])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        elif rest:
            yield [c[:rest] for c in cols]
        held.append([c[rest:] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _units(keyed: DataFrame, own: list[str], tile: int) -> DataFrame:
    """(tab, key, i, j, side, own...): the rows of each (tab, key) cut into tiles, and a unit for every two of them."""
    sizes = keyed.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile)
    tiles = F.coalesce(F.ceil(F.col("n") / tile), F.lit(1)).cast("int")
    tiled = keyed.join(sizes, ["tab", "key"], "left").withColumn("t", tiles).withColumn("tile", F.pmod(F.xxhash64(*own, "tab"), F.col("t")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("t") - 1))
    return tiled.select(*own, "tab", "key", "tile", other.alias("other")).select(
        "tab", "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), F.when(F.col("tile") <= F.col("other"), 0).otherwise(1).alias("side"), *own
    )


def _compared(distinct: DataFrame, keys: list[Column], words: list[str], radius: int) -> DataFrame:
    """(u, v): fp of linked rows of distinct (fp, words...), where rows that share one of keys are compared."""
    own = list(dict.fromkeys(["fp", *words]))
    keyed = distinct.select(*own, F.posexplode(F.array(*keys)).alias("tab", "key"))
    units = _units(keyed, own, TILE)
    first = 5 + own.index(words[0])  # where the words begin
    dealt = units.repartition("tab", "key", "i", "j").sortWithinPartitions("tab", "key", "i", "j")

    def make_runs(batches):
        """Whole units in turn: rows of a unit are next to each other, and a unit is at most two tiles."""
        held: list[list[np.ndarray]] = []

        def solve(parts: list[list[np.ndarray]]) -> pa.RecordBatch | None:
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            ids = np.stack(cols[:4], 1)
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1
            us, vs = [], []
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(ids)]):
                if b - a > 1:
                    u, v = forest(np.stack([c[a:b] for c in cols[first:]], 1).view(np.uint64), cols[4][a:b], radius)
                    us.append(cols[5][a + u])
                    vs.append(cols[5][a + v])
            if not sum(map(len, us)):
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5 + len(own))]
            if not len(cols[0]):
                continue
            last = np.ones(len(cols[0]), bool)
            for c in cols[:4]:
                last &= c == c[-1]
            rest = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if rest:
                held.append([c[:rest] for c in cols])
                if (out := solve(held)) is not None:
                    yield out
                held = []
            elif held and any(held[-1][k][-1] != cols[k][0] for k in range(4)):
                if (out := solve(held)) is not None:
                    yield out
                held = []
            held.append([c[rest:] for c in cols])
        if held and (out := solve(held)) is not None:
            yield out

    return dealt.mapInArrow(make_runs, "u long, v long")


def label(docs: DataFrame, key: str = "doc_id", text: str = "text", near: bool = False) -> DataFrame:
    """(key, fp, component_id) of every row: component_id is the smallest key reachable over links, and with
    near over those of near copies too."""
    return _labelled(docs, key, text, near, False).select(key, "fp", "component_id")


def _labelled(docs: DataFrame, key: str, text: str, near: bool, hashed: bool) -> DataFrame:
    """label() with the component's root, and if hashed the text's hash txt."""
    prints = fingerprints(docs, key, text, near, hashed)
    if near:  # prefixes and parities are the bulk of it, and go as soon as they have been read
        wide, wide_path = kept(prints, "prints")
        sets, sets_path = kept(wide.filter("n > 0").select("set", "n", "parity", "prefix").dropDuplicates(["set"]), "sets")
        prints = cut(wide.drop("parity", "prefix"))
        remove(docs.sparkSession, wide_path)
        members = groups(sets)
        remove(docs.sparkSession, sets_path)
    else:
        prints = cut(prints)
    distinct = cut(prints.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")), True)
    kinds, total, largest = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    found = links(distinct.select("fp"), kinds)
    if near:
        first = cut(prints.filter("n > 0").groupBy("set").agg(F.min("fp").alias("first")), True)
        same = prints.filter("n > 0").select("set", "fp").distinct().join(first, "set").select(F.col("first").alias("u"), F.col("fp").alias("v"))
        u, v = (first.select(F.col("set").alias(x), F.col("first").alias(f"f{x}")) for x in "uv")
        pairs = near_links(docs, prints, members, text).distinct().join(u, "u").join(v, "v").select(F.col("fu").alias("u"), F.col("fv").alias("v"))
        found = found.union(same.filter("u != v")).union(pairs)
    roots = components(found)
    largest_group = roots.groupBy("root").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] + 1
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    by_print = spread_join(rooted.withColumnRenamed("n", "rows"), smallest, "root", kinds, largest_group)
    by_print = by_print.select("fp", "root", "component_id", F.col("rows").alias("n"))
    return spread_join(prints, by_print, "fp", total, largest).select(key, "fp", "root", "component_id", *["txt"] * hashed)


def hex_column(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def filter_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", near: bool = True) -> DataFrame:
    """One row of each component, all columns: one with the component's smallest key, null last (of rows with that
    key, the first by the text's hash). Only rows that share key and text are numbered."""
    marked = _labelled(docs, key, text, near, True)
    rows = marked.groupBy("root", key, "txt").agg(F.count(F.lit(1)).alias("n"))
    least = rows.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "txt", "n")).alias("x"))
    stays = cut(least.select(F.col("x.key").alias("__brevia_key"), F.col("x.txt").alias("__brevia_txt"), (F.col("x.n") > 1).alias("__brevia_again")), True)
    hashed = docs.withColumn("__brevia_hash", F.xxhash64(F.col(text).cast("string").cast("binary")))
    same = F.col("__brevia_hash") == F.col("__brevia_txt")
    kept = hashed.join(stays, same & F.col(key).eqNullSafe(F.col("__brevia_key")))
    order = Window.partitionBy(key, "__brevia_hash").orderBy(F.col(text).asc_nulls_first())
    one = kept.filter("__brevia_again").withColumn("__brevia_row", F.row_number().over(order)).filter("__brevia_row = 1")
    return kept.filter("not __brevia_again").select(*docs.columns).union(one.select(*docs.columns))


def op8_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = label(tables(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_column(F.col("fp")).alias("fingerprint"), "component_id")
