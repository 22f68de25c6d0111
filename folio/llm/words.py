"""Words, word hashes and shingle sets of Arrow string columns, in numpy.

A word is a longest run of bytes other than space and ``\\x09-\\x0D``; no byte
of a longer UTF-8 character is one of these, so bytes and code points agree.
All work is done on blocks of whole documents of about ``BLOCK`` bytes, which
bounds memory for any batch; one longer document is a block by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of words of letters and digits: every other ASCII character.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, BLOCK * 2)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, r, np.uint64)]), dtype=np.uint64) for r in (_BASE, inverse)]
    return _powers


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hashes`` takes the hash of any span of the data."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * _power_tables(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def span_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = _power_tables(len(total))[1]
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """The words of documents ``first`` to ``first + len(counts) - 1`` of a column."""

    first: int
    data: np.ndarray  # bytes of the block
    bounds: np.ndarray  # where documents start in data, and its end
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray  # words per document
    hashes: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of strings with 64-bit offsets; null becomes an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def byte_blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, bytes, bounds) of blocks of whole documents."""
    column = texts_of(column)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def words(column: pa.Array, lower: bool = False, hashed: bool = True, space: np.ndarray = _SPACE) -> Iterator[Words]:
    """The words of a string column, block by block; ``lower`` folds A-Z, ``space`` marks what parts words."""
    for first, data, bounds in byte_blocks(column):
        if lower:
            data = _LOWER[data]
        n = len(data)
        other = ~space[data]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        begin = other.copy()
        begin[1:] &= ~other[:-1] | edge[1:n]
        starts = np.flatnonzero(begin)
        stop = other.copy()
        stop[:-1] &= ~other[1:] | edge[1:n]
        ends = np.flatnonzero(stop) + 1
        counts = np.diff(np.searchsorted(starts, bounds))
        hashes = np.zeros(0, np.uint64)
        if hashed and len(starts):
            hashes = span_hashes(prefix_sums(data), starts, ends)
        yield Words(first, data, bounds, starts, ends, counts, hashes)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of k words within a document."""
    m = len(w.hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = w.hashes[:m].copy()
    for j in range(1, k):
        total *= _STEP
        total += w.hashes[j : j + m]
    doc = w.doc
    inside = np.flatnonzero(doc[:m] == doc[k - 1 : k - 1 + m])
    return inside, mix(total[inside])


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, set sizes, tokens: ascending and distinct within each document).

    A document of fewer than k words has its whole sequence as one token, one
    without words none.
    """
    for w in words(column, lower=True):
        at, tokens = windows(w, k)
        doc = w.doc[at]
        short = np.flatnonzero((w.counts > 0) & (w.counts < k))
        if len(short):
            begins = np.concatenate([[0], np.cumsum(w.counts)])
            whole = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                has = w.counts[short] > j
                whole[has] = whole[has] * _STEP + w.hashes[begins[short[has]] + j]
            tokens = np.concatenate([tokens, mix(whole ^ (w.counts[short].astype(np.uint64) << np.uint64(56)))])
            doc = np.concatenate([doc, short])
            order = np.argsort(doc, kind="stable")
            tokens, doc = tokens[order], doc[order]
        ends = np.searchsorted(doc, np.arange(len(w.counts) + 1))
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            tokens[a:b].sort()
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1])
        yield w.first, np.bincount(doc[fresh], minlength=len(w.counts)), tokens[fresh]
