"""Vectorised words of UTF-8 texts: positions, hashes and n-gram hashes, without a Python loop over words.

A word is a maximal run of bytes outside space and 0x09-0x0D, the same as the
code-point pattern ``[^\\x20\\x09-\\x0D]+``, as those six are single bytes in UTF-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that are handled at once; a slice is longer only where a single word is.
SLICE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RNG.integers(1, 1 << 62)) * 8 + 5
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        n = max(n, SLICE + 1)
        step, back = np.uint64(_BASE % (1 << 64)), np.uint64(pow(_BASE, -1, 1 << 64))
        p, q = np.full(n, step, np.uint64), np.full(n, back, np.uint64)
        p[0] = q[0] = 1
        _POWERS, _INVERSE = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
    return _POWERS, _INVERSE


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9FB21C651E98DF25)
    h = h ^ (h >> np.uint64(28))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the len + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    size = int(at[-1] - at[0]) if len(column) else 0
    if not size:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """Words of a batch of texts: ``start`` and ``end`` byte positions, ``hash``, and ``first``: the word index at which each text begins."""

    def __init__(self, column: pa.Array, lower: bool = False, hashes: bool = True):
        self.bytes, self.offsets = raw(column)
        if lower:
            self.bytes = _LOWER[self.bytes]
        space = _SPACE[self.bytes]
        n = len(space)
        if n:
            begins = ~space
            begins[1:] &= space[:-1]
            ends = ~space
            ends[:-1] &= space[1:]
            # a text's first byte begins a word, its last byte ends one
            inner = self.offsets[1:-1]
            inner = inner[(inner > 0) & (inner < n)]
            begins[inner] = ~space[inner]
            ends[inner - 1] = ~space[inner - 1]
            self.start = np.flatnonzero(begins)
            self.end = np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash = self._hashes() if hashes else None

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            at = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, at + SLICE, "right")))
            piece = self.bytes[at : int(self.end[j - 1])]
            p, q = _powers(len(piece) + 1)
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE[piece] * p[: len(piece)], dtype=np.uint64, out=sums[1:])
            s = self.start[i:j] - at
            out[i:j] = (sums[self.end[i:j] - at] - sums[s]) * q[s]
            i = j
        return mix(out)

    def doc(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]].tobytes()


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of n successive word hashes; shorter by n - 1."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0xA24BAED4963EE407) + h[k : len(h) - n + 1 + k])
    return out


def slices(column: pa.Array, size: int = SLICE) -> list[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each, one row at least."""
    _, at = raw(column)
    out, i = [], 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        out.append((i, j))
        i = j
    return out
