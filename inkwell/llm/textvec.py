"""Vectorised word splitting and hashing over Arrow string buffers.

A batch of texts is one byte buffer with row offsets.  Words are maximal runs of bytes outside
``\\x20 \\x09-\\x0D``; those bytes never occur inside a multi-byte UTF-8 character.  Each word gets
a 64-bit hash from polynomial prefix sums over its bytes, each n-gram one from prefix sums over
its words, so no Python loop runs per word.  Buffers are cut at row borders into slices of about
``SLICE`` bytes, which bounds memory; a longer text forms a slice of its own, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
_M64 = (1 << 64) - 1
_P, _Q, _R = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, extended on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 12)
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(self.n - 1, b, np.uint64)], dtype=np.uint64) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers, _second_powers = _Powers(_P), _Powers(_Q), _Powers(_R)


@dataclass
class Words:
    """Words of some rows: byte bounds in ``data``, row number, hash; ``first[r]`` to ``first[r+1]`` are row r's."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each position, and whether they all lie in one row."""
        return ngrams(self.hash, self.row, n)


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    k = len(h) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    return span_hash(h, np.arange(k), np.arange(n, n + k)), row[:k] == row[n - 1 :]


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """Hash of the words [start, end) of each span; equal to that of ngrams for equal words.

    The ``second`` hash is independent of the first: together they are 128 bits of evidence.
    """
    up, down = (_second_powers if second else _word_powers).upto(len(h) + 1)
    if second:
        h = mix(h ^ np.uint64(_R))
    c = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=c[1:])
    return mix((c[end] - c[start]) * down[start] + (end - start).astype(np.uint64))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type):
        kind = np.int32
    else:
        texts, kind = texts.cast(pa.large_string()), np.int64
    _, offsets, data = texts.buffers()
    n = len(texts)
    o = np.frombuffer(offsets, kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(offsets: np.ndarray, target: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``target`` bytes."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + target, "right")) - 1)
        yield a, min(b, n)
        a = b


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word, in stretches of about SLICE bytes, so that a long text needs little beside itself."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE, "right")))
        a, b = start[i:j] - start[i], end[i:j] - start[i]
        up, down = _byte_powers.upto(int(b[-1]) + 1)
        c = np.zeros(b[-1] + 1, np.uint64)
        np.cumsum(_BYTE[data[start[i] : end[j - 1]]] * up[:-1], out=c[1:])
        out[i:j] = mix((c[b] - c[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = ~_WS[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1] | border[1:-1]
        ends[:-1] &= ~inside[1:] | border[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = _word_hashes(data, start, end)
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, row, h, first)


def word_slices(texts: pa.Array, lower: bool, target: int = SLICE) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for each slice of a string array."""
    data, offsets = buffers(texts)
    for a, b in slices(offsets, target):
        lo, hi = offsets[a], offsets[b]
        yield a, b, split_words(data[lo:hi], offsets[a : b + 1] - lo, lower)


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within rows, and row bounds.

    A row with fewer than n words has its whole sequence as one shingle, one without words none.
    """
    g, ok = w.ngrams(n)
    row, g = w.row[: len(g)][ok], g[ok]
    counts = np.diff(w.first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        g = np.r_[g, span_hash(w.hash, w.first[short], w.first[short + 1])]
        row = np.r_[row, short]
        order = np.argsort(row, kind="stable")
        g, row = g[order], row[order]
    bounds = np.searchsorted(row, np.arange(w.rows + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        g[a:b].sort()
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[keep], row[keep]
    return g, np.searchsorted(row, np.arange(w.rows + 1))
