"""Ids of repeated pieces of text, kept by hash in a bounded table."""

from __future__ import annotations

import numpy as np

from brevia.llm.textkit import U, mix, powers


def span_keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keys of points[start:end], the same wherever they stand."""
    up, down = powers(len(points) + 1)
    h = np.zeros(len(points) + 1, U)
    np.cumsum(mix(points.astype(U) + U(1)) * up[:-1], out=h[1:])
    return mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


class KnownPieces:
    """Sequences of ids by key, at most `most` of them: beyond that all are forgotten and learnt anew."""

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.keys, self.first, self.size = np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.used = np.empty(1 << 16, np.int32), 0

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Which of the sorted distinct keys must be learnt before ids() of them all."""
        if not len(self.keys):
            return np.ones(len(keys), bool)
        where = np.searchsorted(self.keys, keys)
        new = self.keys[np.minimum(where, len(self.keys) - 1)] != keys
        if len(self.keys) + new.sum() > self.most and new.any():
            self.forget()
            return np.ones(len(keys), bool)
        return new

    def learn(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """keys: sorted, none known; ids: their sequences in turn; size: the sequences' lengths."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(len(ids), self.used), np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(size) - size
        self.used += len(ids)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.size = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.size, at, size)

    def ids(self, keys: np.ndarray, which: np.ndarray, pieces_before: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of documents whose pieces are keys[which], pieces_before[d] of them before document d,
        each document followed by end, if given; and n + 1 offsets."""
        where = np.searchsorted(self.keys, keys)
        size = self.size[where][which]
        before = np.cumsum(size) - size
        shift = np.repeat(self.first[where][which] - before, size)
        ids = self.pool[shift + np.arange(len(shift))]
        at = np.append(0, np.cumsum(size))[pieces_before]
        if end is None:
            return ids, at
        n = len(at) - 1
        out_at = at + np.arange(n + 1)
        out = np.full(out_at[-1], end, np.int32)
        out[np.repeat(np.repeat(np.arange(n), np.diff(pieces_before)), size) + np.arange(len(ids))] = ids
        return out, out_at
