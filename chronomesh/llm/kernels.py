"""Vectorised text kernels for use inside Arrow batches.

A batch is cut into blocks of a few megabytes of text, so memory follows the block (or one
text, if it is longer), never the partition. Words are runs of ``[^\\x20\\x09-\\x0D]``; every
word gets a 64-bit hash, and a window of words gets a hash of its words' hashes. Two different
words or windows share a hash with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
_SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and ASCII punctuation: what stands between words when punctuation does not count.
BREAK = np.array([not (chr(c).isalnum() or c >= 128) for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS.get("up", np.empty(0)).size < n:
        size = max(n, _SEGMENT)
        _POWERS["up"], _POWERS["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> _S33)) * _M1
    h = (h ^ (h >> _S33)) * _M2
    return h ^ (h >> _S33)


def texts_of(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is the empty text."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or one text."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(text) + 1
    if lo < len(texts):
        yield lo, len(texts)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every run ``data[start:end]``; runs are ascending and disjoint."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + _SEGMENT, "right")))
        span = data[base:ends[hi - 1]]
        up, down = _tables(len(span) + 1)
        sums = np.zeros(len(span) + 1, np.uint64)
        np.cumsum((span.astype(np.uint64) + np.uint64(1)) * up[:len(span)], out=sums[1:])
        a, b = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        lo = hi
    return mix(out)


class Words:
    """The words of a block of texts, in order.

    ``start`` and ``end`` are byte positions in ``data`` (the texts, each followed by a line
    break), ``doc`` is the text a word belongs to, ``count`` the words of each text and ``first``
    the position of each text's first word.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, space: np.ndarray = SPACE):
        joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.data = LOWER[joined] if lower else joined
        self.n = len(texts)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, self.n)
        self.text_end = np.cumsum(sizes)
        self.text_start = self.text_end - sizes
        inside = np.zeros(len(joined) + 1, bool)
        inside[1:] = ~space[joined]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.text_start)
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.doc = np.repeat(np.arange(self.n), self.count)
        self._hash: np.ndarray | None = None

    def only(self, keep: np.ndarray) -> Words:
        """The words of the texts in the mask; ``data`` is shared."""
        out, words = object.__new__(Words), keep[self.doc]
        out.data, out.n = self.data, int(keep.sum())
        out.text_start, out.text_end = self.text_start[keep], self.text_end[keep]
        out.start, out.end, out.count = self.start[words], self.end[words], self.count[keep]
        out.first = np.cumsum(out.count) - out.count
        out.doc = np.repeat(np.arange(out.n), out.count)
        out._hash = None if self._hash is None else self._hash[words]
        return out

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_runs(self.data, self.start, self.end)
        return self._hash

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``size`` words inside one text."""
        total = len(self.start) - size + 1
        if total <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.doc[:total] == self.doc[size - 1:])
        return at, window_hash(self.hash, size)[at]


def window_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive entries."""
    total = len(words) - size + 1
    factors = _powers(_M1.item(), size + 1)[1:]
    out = np.full(total, size, np.uint64)
    for j in range(size):
        out += words[j:j + total] * factors[j]
    return mix(out)


def repeated(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over entries whose (owner, key) occurs twice or more: all of them, and all but the first."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((key, owner)) if owner is not None else np.argsort(key, kind="stable")
    k, o = key[order], owner[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    every, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    every[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return every, later


def per_text(n: int, owner: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Number of entries of each of ``n`` texts."""
    return np.bincount(owner if mask is None else owner[mask], minlength=n).astype(np.int64)
