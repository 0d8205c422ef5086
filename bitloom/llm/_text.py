"""Whole columns of text as numpy arrays: words, 64-bit word hashes and hashes of word windows.

A word is a run of bytes other than U+0020 and U+0009..U+000D, so UTF-8 text is scanned bytewise
and no text is decoded. Arrow columns are cut into pieces of about ``PIECE`` bytes (a longer text
is one piece), which bounds the memory of every caller. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C13 | 3
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_MULT = _rng.integers(0, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, PIECE + 1024)
        steps = np.full(n, _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
        steps[1:] = pow(_BASE, -1, 1 << 64)
        _inverse = np.multiply.accumulate(steps)


def texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column without nulls, as one array with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(column.cast(pa.large_string()), "")


def pieces(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets): consecutive rows of about PIECE bytes; offsets has a leading 0."""
    column = texts(column)
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + PIECE, "right")) - 1)
        yield slice(at, to), data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of words; row r has the words first[r] .. first[r + 1] - 1."""
    n = len(data)
    solid = ~_SPACE[data]
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of words, the same on every machine; lower: A-Z count as a-z."""
    _grow(len(data) + 1)
    v = (_LOWER if lower else _TABLE)[data]
    v *= _powers[: len(data)]
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(v, out=total[1:])
    h = (total[ends] - total[starts]) * _inverse[starts]
    h += (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    return mix(h)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive values, len(h) - k + 1 of them; windows may span rows."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += h[j : j + n] * _MULT[j]
    return mix(out + _U(k))


def inside(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, rows) of the windows of k values that stay within a row."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    rows = np.repeat(np.arange(len(n)), n)
    skip = np.concatenate(([0], np.cumsum(n)))[:-1]
    return np.arange(int(n.sum())) - skip[rows] + first[:-1][rows], rows


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, first): each row's distinct k-word shingles of the lower-cased words, sorted.

    A row of fewer than k words has one shingle, its whole sequence, and one without words has none.
    """
    s, e, first = words(data, offsets)
    h = word_hashes(data, s, e, lower=True)
    at, rows = inside(first, k)
    v = window_hashes(h, k)[at]
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for i, r in enumerate(short):
            extra[i] = window_hashes(h[first[r] : first[r + 1]], int(n[r]))[0]
        v, rows = np.concatenate((v, extra)), np.concatenate((rows, short))
    order = np.lexsort((v, rows))
    v, rows = v[order], rows[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (rows[1:] != rows[:-1])
    v, rows = v[keep], rows[keep]
    return v, np.searchsorted(rows, np.arange(len(offsets)))
