"""Vectorised text statistics on the bytes of an Arrow string column.

Words are runs of bytes other than 0x20 and 0x09-0x0D, which is the same in UTF-8 bytes and in
code points. A substring is known by a 64-bit polynomial hash taken from prefix sums, mixed with
what it must agree on (its document, its length).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
HEAD = (np.arange(256) & 0xC0) != 0x80
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
LETTER[192:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
FINAL = np.zeros(256, bool)
FINAL[list(b".!?:;\"')")] = True
LOUD = np.zeros(256, bool)
LOUD[list(b"!")] = True

#: Function words of the corpus languages (English, German, French, Spanish).
STOP_WORDS = (
    "the of and to in is that for it on was with be as are by this have from or an at "
    "der die und das den von zu mit sich des ist ein eine nicht auf "
    "le la les de du en un une et que qui dans pour par est au sur "
    "el los las del y se por con para su al como"
).split()


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U))
_powers = [np.empty(0, U), np.empty(0, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(max(n, CHUNK + 1), base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i]: the hash of data[:i]; see span_hash."""
    h = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE[data] * powers(len(data))[0], out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same wherever the bytes stand."""
    return mix((h[ends] - h[starts]) * powers(len(h))[1][starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def hash_of(text: str) -> int:
    raw = np.frombuffer(text.encode(), np.uint8)
    return int(span_hash(prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0])


_STOP = np.sort(np.array([hash_of(w) for w in sorted(set(STOP_WORDS))], U))


def is_in(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return keys[at] == h if len(keys) else np.zeros(len(h), bool)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column (null: empty) and its n + 1 offsets, from 0."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, where, raw = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, bytes, offsets) of runs of whole documents of about size bytes."""
    k, n = 0, len(offsets) - 1
    while k < n:
        end = min(max(int(np.searchsorted(offsets, offsets[k] + size, "right")) - 1, k + 1), n)
        yield k, end, data[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k]
        k = end


def counts(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of mask are set, by document."""
    return np.diff(running(mask)[offsets])


def running(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each document (n + 1)."""
    ink = np.zeros(len(data) + 2, bool)
    np.logical_not(SPACE[data], out=ink[1:-1])
    body = ink[1:-1]
    first, last = body & ~ink[:-2], body & ~ink[2:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = body[inner]
    last[inner - 1] = body[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By position: does its key occur twice or more; is it one of the occurrences but one."""
    order = np.argsort(keys)
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    twice, again = np.empty(len(k), bool), np.empty(len(k), bool)
    twice[order], again[order] = same[:-1] | same[1:], same[:-1]
    return twice, again


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Of each text its distinct shingles of size words (A-Z lower-cased; fewer words: the whole sequence) as
    sorted 64-bit keys, which depend on the words alone."""
    data, offsets = text_bytes(column)
    step = np.multiply.accumulate(np.full(size, BASE, U))
    for _, _, part, at in chunks(data, offsets):
        low = LOWER[part]
        starts, ends, first = word_spans(low, at)
        words = span_hash(prefix_hash(low), starts, ends)
        keys = np.zeros(max(0, len(words) - size + 1), U)
        for k in range(size):
            keys += words[k : k + len(keys)] * step[k]
        keys = mix(keys)
        first = first.tolist()
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= size:
                yield np.unique(keys[a : b - size + 1])
            else:
                yield mix(np.sum(words[a:b] * step[: b - a], keepdims=True) + U(b - a)) if b > a else np.empty(0, U)


STATS = (
    "n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
    "n_upper", "n_letters", "n_digits", "n_final_lines", "n_loud", "n_stop", "n_distinct",
)


def chunk_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """STATS of each document.

    n_chars and word_chars count code points; n_lines, n_dup_lines and n_final_lines count lines with
    a word (n_dup_lines: equal to an earlier line of the document); n_repeat_words counts the words in
    3-word windows that occur twice or more in the document.
    """
    n = len(offsets) - 1
    out: dict[str, np.ndarray] = {}
    starts, ends, first = word_spans(data, offsets)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    head = HEAD[data]
    out["n_chars"] = counts(head, offsets)
    out["n_words"] = n_words
    out["word_chars"] = counts(head & ~SPACE[data], offsets)
    for name, table in (("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_letters", LETTER), ("n_digits", DIGIT), ("n_loud", LOUD)):
        out[name] = counts(table[data], offsets)
    h = prefix_hash(data)
    words = span_hash(h, starts, ends)
    salt = mix(np.arange(1, n + 1, dtype=U))
    out["n_stop"] = counts(is_in(words, _STOP), first)
    _, again = repeated(words ^ salt[doc])
    out["n_distinct"] = n_words - counts(again, first)

    out["n_repeat_words"] = np.zeros(n, np.int64)
    if len(words) > 2:
        keys = mix(words[:-2] + U(3) * mix(words[1:-1] + U(7) * words[2:])) ^ salt[doc[:-2]]
        inside = doc[:-2] == doc[2:]
        at = np.flatnonzero(inside)
        twice, _ = repeated(keys[at])
        hit = at[twice]
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[hit + k] = True
        out["n_repeat_words"] = counts(covered, first)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, line_starts)], offsets[line_doc + 1])
    before = np.searchsorted(starts, line_starts)
    inked = np.searchsorted(starts, line_ends) > before
    line_starts, line_ends, line_doc = line_starts[inked], line_ends[inked], line_doc[inked]
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    _, again = repeated(span_hash(h, line_starts, line_ends) ^ salt[line_doc])
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n)
    last = ends[np.searchsorted(starts, line_ends) - 1] - 1 if len(line_ends) else line_ends
    out["n_final_lines"] = np.bincount(line_doc[FINAL[data[last]]], minlength=n)
    return out


def column_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """STATS of each text of a string column, whole texts, in chunks of bounded memory."""
    data, offsets = text_bytes(column)
    out = {name: np.zeros(len(offsets) - 1, np.int64) for name in STATS}
    for k, end, part, at in chunks(data, offsets):
        for name, values in chunk_stats(part, at).items():
            out[name][k:end] = values
    return out
