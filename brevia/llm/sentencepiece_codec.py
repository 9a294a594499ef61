"""SentencePiece encoding and decoding by a batched Viterbi pass in numpy.

A text is cut where no piece of the vocabulary can span the cut (two neighbouring characters that
follow each other in no piece). The distinct words of a batch are encoded once: words of equal length
advance together, one character a step. At each step the substrings that end there are hashed from
prefix sums and probe the sorted piece keys; the candidates' values form a matrix whose row maxima,
with their positions as backpointers, are the next column of the lattice.

Unigram models: a candidate's value is the best value before it plus the piece's score.

BPE models: the piece with the best sum of scores isn't what BPE merges to, so a candidate's value
is 0 if it can follow the last piece before it and minus infinity if not. Two pieces can follow each
other if BPE, run on both together, gives them back, which is seen by undoing their merges from the
latest on and looking for a merge across the border that would have come first. A sequence whose
neighbours all pass is BPE's result, and there is one for each prefix; so the maxima are unique and
the pass gives the library's ids. Words of over LONG characters are merged directly, by a heap.

Null and empty texts have no ids. Repeated rows are encoded alike. Extra columns are left out by
encode_documents(), kept by add_ids(). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from brevia.llm.pieces import KnownPieces, span_keys
from brevia.llm.shared import map_arrow, tables
from brevia.llm.textkit import CHUNK, HEAD, U, chunks, mix, powers, text_bytes

BLANK = 0x2581
LONG = 256
MOST_WORDS = 1 << 20
BUCKET_BITS = 18
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
LAST = np.iinfo(np.int32).max


def merge(parts: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """BPE: merges the neighbours whose union has the least rank, the leftmost of equals, until none has one.
    Also gives the last two that were merged."""
    nxt, prev, alive = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1)), [True] * len(parts)
    parts = list(parts)
    heap = [(rank[a + b], i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
    heapq.heapify(heap)
    last = None
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i] if alive[i] else len(parts)
        if j >= len(parts) or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], nxt[i], last = a + b, False, nxt[j], (a, b)
        if nxt[i] < len(parts):
            prev[nxt[i]] = i
            if (both := parts[i] + parts[nxt[i]]) in rank:
                heapq.heappush(heap, (rank[both], i, parts[i], parts[nxt[i]]))
        if prev[i] >= 0 and (both := parts[prev[i]] + parts[i]) in rank:
            heapq.heappush(heap, (rank[both], prev[i], parts[prev[i]], parts[i]))
    return [p for p, x in zip(parts, alive, strict=True) if x], last


class Codec:
    """A model file with identity normalisation, byte fallback and, as in most, blanks only before a word."""

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not trainer.byte_fallback:
            raise ValueError("models with identity normalisation and byte fallback only")
        self.bpe, self.dummy_prefix = trainer.model_type == trainer.BPE, spec.add_dummy_prefix
        self.n = len(model.pieces)
        usable = {p.piece: k for k, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        score = np.array([p.score for p in model.pieces], np.float64)
        self._decoding(model)
        self.byte_ids = np.zeros(256, np.int32)
        for k, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = k

        blanks = {p for p in usable if len(p) > 1 and not p.strip(chr(BLANK))}
        rest = [score[k] for p, k in usable.items() if len(p) > 1 and p not in blanks]
        #: runs of blanks are merged after all else, so they can be left to the end
        self.late_blanks = self.bpe and bool(blanks) and (not rest or max(score[usable[p]] for p in blanks) < min(rest))
        ordered = sorted((p for p in usable if len(p) > 1), key=lambda p: -score[usable[p]])
        ranks: dict[str, int] = {}
        for k, p in enumerate(ordered):
            ranks[p] = ranks[ordered[k - 1]] if k and score[usable[ordered[k - 1]]] == score[usable[p]] else k
        self.blank_ranks = {p: ranks[p] for p in blanks}
        self.ranks = {p: r for p, r in ranks.items() if not (self.late_blanks and p in blanks)}
        self.piece_id = dict(usable)
        #: characters of pieces that are no piece themselves: ids from self.n on, written as bytes
        self.bare = sorted({c for p in self.ranks for c in p if c not in usable})
        self.piece_id |= {c: self.n + k for k, c in enumerate(self.bare)}

        words = [p for p in self.piece_id if len(p) == 1 or p in self.ranks]
        chars = sorted({c for p in words for c in p})
        self.char = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.follows = np.zeros((len(chars) + 1) ** 2, bool)
        self.width = len(chars) + 1
        for p in words:
            at = self.char[[ord(c) for c in p]]
            self.follows[at[:-1].astype(np.int64) * self.width + at[1:]] = True

        total = self.n + len(self.bare)
        self.score = np.append(score, np.full(len(self.bare), score.min()))
        self.rank, self.left, self.right = np.full(total, -1, np.int32), np.zeros(total, np.int32), np.zeros(total, np.int32)
        good = []
        for p in words:
            k = self.piece_id[p]
            self.left[k] = self.right[k] = k
            if self.bpe and len(p) > 1:
                whole, split = merge(list(p), self.ranks)
                if len(whole) > 1:
                    continue  # BPE never arrives at this piece
                self.rank[k], self.left[k], self.right[k] = self.ranks[p], self.piece_id[split[0]], self.piece_id[split[1]]
            good.append(p)
        self.longest = max(map(len, good))
        self.hash, self.length = np.zeros(total, U), np.zeros(total, np.int64)
        for p in words:
            points = np.array([ord(c) for c in p])
            self.hash[self.piece_id[p]] = (mix(points.astype(U) + U(1)) * powers(len(p))[0]).sum(dtype=U)
            self.length[self.piece_id[p]] = len(p)
        #: a merge across a border may make any piece, a lattice holds only those that BPE arrives at
        self.any_keys = self._table([self.piece_id[p] for p in words if len(p) > 1])
        self.keys = self._table([self.piece_id[p] for p in good])
        self.known = KnownPieces(MOST_WORDS)
        self.runs: dict[int, list[int]] = {}

    # --- the sorted piece keys --------------------------------------------------------------------

    def _table(self, ids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        ids = np.array(ids, np.int32)
        keys = mix(self.hash[ids] + self.length[ids].astype(U))
        order = np.argsort(keys)
        heads = np.searchsorted(keys[order], np.arange((1 << BUCKET_BITS) + 1, dtype=U) << U(64 - BUCKET_BITS))
        heads[-1] = len(keys)
        return np.append(keys[order], U(0)), np.append(ids[order], -1).astype(np.int32), heads, int(np.diff(heads).max(initial=0))

    @staticmethod
    def _probe(table, hashes: np.ndarray, lengths) -> np.ndarray:
        """Piece ids of substrings, -1 where there is none."""
        keys, ids, heads, depth = table
        want = mix(hashes + lengths)
        at = heads[want >> U(64 - BUCKET_BITS)]
        out = np.full(want.shape, -1, np.int32)
        for k in range(depth):
            hit = keys[np.minimum(at + k, len(keys) - 1)] == want
            out[hit] = ids[at[hit] + k]
        return out

    def _can_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE on the pieces a and b together gives a and b: see above."""
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), LAST, np.int64)
        while len(at):
            size = self.length[a]
            union = self._probe(self.any_keys, self.hash[a] + self.hash[b] * powers(LONG + 64)[0][size], (size + self.length[b]).astype(U))
            rank = np.where(union >= 0, self.union_rank(union), LAST)
            across = rank < limit
            out[at[across]] = False
            ra, rb = self.rank[a], self.rank[b]
            left = ~across & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[left], a[left], b[left], ra[left], rb[left]
            later = ra > rb
            limit = np.where(later, ra, rb.astype(np.int64) + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    def union_rank(self, ids: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_all_ranks"):
            self._all_ranks = np.full(len(self.rank) + 1, LAST, np.int64)
            for p, r in self.ranks.items():
                self._all_ranks[self.piece_id[p]] = r
        return self._all_ranks[ids]

    # --- encoding ---------------------------------------------------------------------------------

    def _lattice(self, points: np.ndarray) -> list[np.ndarray]:
        """Piece ids of words: points is words x length, all characters known."""
        n, size = points.shape
        up, down = powers(size + 1)
        h = np.zeros((n, size + 1), U)
        np.cumsum(mix(points.astype(U) + U(1)) * up[:-1], axis=1, out=h[:, 1:])
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        last, back = np.full((n, size + 1), -1, np.int32), np.zeros((n, size + 1), np.int32)
        for j in range(1, size + 1):
            i = max(0, j - self.longest)
            spans = (h[:, j : j + 1] - h[:, i:j]) * down[i:j]
            piece = self._probe(self.keys, spans, np.arange(j - i, 0, -1).astype(U))
            row, k = np.nonzero((piece >= 0) & (best[:, i:j] > -np.inf))
            cur, before = piece[row, k], last[row, i + k]
            value = best[row, i + k]
            if self.bpe:
                ask = np.flatnonzero(before >= 0)
                fits = np.ones(len(row), bool)
                fits[ask] = self._can_follow(before[ask], cur[ask])
                value = np.where(fits, value, -np.inf)
            else:
                value = value + self.score[cur]
            values = np.full((n, j - i), -np.inf)
            values[row, k] = value
            chosen = values.argmax(1)
            rows = np.arange(n)
            best[:, j], back[:, j], last[:, j] = values[rows, chosen], i + chosen, piece[rows, chosen]
        if not np.isfinite(best[:, size]).all():
            raise RuntimeError("no segmentation found")
        out = np.full((n, size), -1, np.int32)
        at, rows = np.full(n, size), np.arange(n)
        for k in range(size - 1, -1, -1):
            some = rows[at[rows] > 0]
            if not len(some):
                break
            out[some, k] = last[some, at[some]]
            at[some] = back[some, at[some]]
        return out

    def _direct(self, text: str) -> list[int]:
        return [self.piece_id[p] for p in merge(list(text), self.ranks)[0]]

    def _encode_words(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each word."""
        length = ends - starts
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        unknown = (length == 1) & (self.char[points[starts]] == 0)
        for k in np.flatnonzero(unknown).tolist():
            ids = self.byte_ids[list(chr(points[starts[k]]).encode())]
            parts.append((np.full(len(ids), k), np.arange(len(ids)), ids))
        for size in np.unique(length[~unknown]).tolist():
            at = np.flatnonzero((length == size) & ~unknown)
            if size > LONG and self.bpe:
                for k in at.tolist():
                    ids = np.array(self._direct(points[starts[k] : ends[k]].astype("<u4").tobytes().decode("utf-32-le")), np.int32)
                    parts.append((np.full(len(ids), k), np.arange(len(ids)), ids))
                continue
            step = max(1, (1 << 18) // size)
            for a in range(0, len(at), step):
                some = at[a : a + step]
                found = self._lattice(points[starts[some][:, None] + np.arange(size)])
                row, k = np.nonzero(found >= 0)
                parts.append((some[row], k, found[row, k]))
        word, place, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, word))
        ids, word = ids[order], word[order]
        if len(self.bare) and (ids >= self.n).any():
            out = [[*self.byte_ids[list(self.bare[x - self.n].encode())]] if x >= self.n else [x] for x in ids.tolist()]
            word = np.repeat(word, [len(x) for x in out])
            ids = np.array([y for x in out for y in x], np.int32)
        return ids, np.bincount(word, minlength=len(starts))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and n + 1 offsets."""
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = np.zeros(len(data) + 1, np.int64)
        np.cumsum(HEAD[data], out=heads[1:])
        at = heads[offsets]
        points = np.where(points == 0x20, np.uint32(BLANK), points)
        if self.dummy_prefix:
            some = np.diff(at) > 0
            points = np.insert(points, at[:-1][some], np.uint32(BLANK))
            at = at + np.append(0, np.cumsum(some))
        if not len(points):
            return np.empty(0, np.int32), at
        char = self.char[points].astype(np.int64)
        opens = np.ones(len(points), bool)
        opens[1:] = ~self.follows[char[:-1] * self.width + char[1:]]
        opens[at[:-1][at[:-1] < len(points)]] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(points))
        distinct, one, which = np.unique(span_keys(points, starts, ends), return_index=True, return_inverse=True)
        new = self.known.missing(distinct)
        if new.any():
            ids, size = self._encode_words(points, starts[one[new]], ends[one[new]])
            self.known.learn(distinct[new], ids, size)
        ids, out_at = self.known.ids(distinct, which, np.searchsorted(starts, at))
        return self._join_blanks(ids, out_at) if self.late_blanks else (ids, out_at)

    def _join_blanks(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges runs of single blanks that no word has taken."""
        blank = self.piece_id[chr(BLANK)]
        is_blank = ids == blank
        first = np.ones(len(ids), bool)
        first[1:] = ~(is_blank[1:] & is_blank[:-1])
        first[at[:-1][at[:-1] < len(ids)]] = True
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(ids)))
        if not (size > 1).any():
            return ids, at
        runs = sorted(set(size[size > 1].tolist()))
        for m in runs:
            if m not in self.runs:
                self.runs[m] = [self.piece_id[p] for p in merge([chr(BLANK)] * m, self.blank_ranks)[0]]
        pool = np.concatenate([ids[begin], *(np.array(self.runs[m], np.int32) for m in runs)])
        where = dict(zip(runs, (len(begin) + np.cumsum([0] + [len(self.runs[m]) for m in runs[:-1]])).tolist(), strict=True))
        source, out_size = np.arange(len(begin)), np.ones(len(begin), np.int64)
        for m in runs:
            source[size == m], out_size[size == m] = where[m], len(self.runs[m])
        before = np.cumsum(out_size) - out_size
        out = pool[np.repeat(source - before, out_size) + np.arange(out_size.sum())]
        return out, np.append(0, np.cumsum(out_size))[np.searchsorted(begin, at)]

    # --- decoding ---------------------------------------------------------------------------------

    def _decoding(self, model) -> None:
        raw = []
        for p in model.pieces:
            if p.type == BYTE:
                raw.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == CONTROL:
                raw.append(b"")
            elif p.type == UNKNOWN:
                raw.append((model.trainer_spec.unk_surface or " ⁇ ").encode())
            else:
                raw.append(p.piece.replace(chr(BLANK), " ").encode())
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of documents of ids, and n + 1 offsets; the blank that encoding put first is left out."""
        size = self.raw_size[ids]
        before = np.cumsum(size) - size
        out = self.raw[np.repeat(self.raw_at[ids] - before, size) + np.arange(size.sum())]
        out_at = np.append(0, np.cumsum(size))[at]
        if self.dummy_prefix:
            first = out_at[:-1][np.diff(out_at) > 0]
            first = first[out[first] == 0x20]
            out = np.delete(out, first)
            out_at = out_at - np.searchsorted(first, out_at)
        return out, out_at


def _encoded(codec: Codec, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    ids, at = [], [np.zeros(1, np.int64)]
    for _, _, part, where in chunks(data, offsets, 2 * CHUNK):
        x, y = codec.encode(part, where)
        ids.append(x)
        at.append(y[1:] + at[-1][-1])
    return np.concatenate(ids) if ids else np.empty(0, np.int32), np.concatenate(at)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each model and worker process: its known words last from task to task."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def ids_column(text: Column, path: str) -> Column:
    """The ids of a text column as an array<int> column."""

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        ids, at = _encoded(codec(path), column)
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))

    return encode(text)


def text_column(ids: Column, path: str) -> Column:
    """The text of an array<int> column of ids; null lists are empty texts, bad UTF-8 gives U+FFFD."""

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        column = column.fill_null([]) if column.null_count else column
        at = column.offsets.to_numpy().astype(np.int64)
        out, out_at = codec(path).decode(column.values.to_numpy()[at[0] : at[-1]], at - at[0])
        raw = out.tobytes()
        return pa.array([raw[a:b].decode(errors="replace") for a, b in zip(out_at[:-1].tolist(), out_at[1:].tolist(), strict=True)], pa.string())

    return decode(ids)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_ids, ids, ids_crc32, decoded_sha256, round_trip) of every row, in one pass.

    The text is encoded, and what is decoded from the ids is hashed and held against the text
    (in which U+2581, the model's own sign for a blank, counts as one).
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            model = codec(path)
            ids, at = _encoded(model, batch.column(1))
            data, offsets = text_bytes(batch.column(1))
            sums, hashes, same = [], [], []
            for k in range(0, len(offsets) - 1, 64):
                end = min(k + 64, len(offsets) - 1)
                out, out_at = model.decode(ids[at[k] : at[end]], at[k : end + 1] - at[k])
                raw = out.tobytes()
                for d in range(k, end):
                    decoded = raw[out_at[d - k] : out_at[d - k + 1]]
                    sums.append(zlib.crc32(ids[at[d] : at[d + 1]].astype("<i4", copy=False)))
                    hashes.append(hashlib.sha256(decoded).hexdigest())
                    same.append(decoded == data[offsets[d] : offsets[d + 1]].tobytes().replace(chr(BLANK).encode(), b" "))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            columns = [batch.column(0), pa.array(np.diff(at)), lists, pa.array(sums, pa.int64()), pa.array(hashes, pa.string()), pa.array(same, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, [key, "n_ids", "ids", "ids_crc32", "decoded_sha256", "round_trip"])

        return step

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_ids long, ids array<int>, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return map_arrow(docs.select(F.col(key), F.col(text).cast("string").alias("text")), schema, make)


def op2_sentencepiece(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    return encode_documents(tables(spark, sf_dir, "documents"), model or public_tokenizers.path("piece_bpe_32k.model"))
