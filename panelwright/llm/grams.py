"""Word and n-gram hashes of Arrow text columns, in numpy.

A column's bytes are hashed in blocks: a running sum of byte times power gives
every word's polynomial hash (modulo 2**64, mixed afterwards) from its two ends,
so no word becomes a Python object. Equal words have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 18
#: Bytes of text in one batch handed on; a longer text is a batch of its own.
BATCH = 1 << 21

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


_POW, _INV = _powers(BASE, BLOCK + 1), _powers(INVERSE, BLOCK + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works on a copy."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def batches(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a text column of about BATCH bytes, with their first row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + BATCH, "right")) - 1
        end = min(max(end, start + 1), n)
        yield start, column.slice(start, end - start)
        start = end


def words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a large_string column in order, and each row's count of words.

    Words are what stands between ASCII white space; null rows have none.
    """
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, U), np.zeros(n, np.int64)
    gap = _SEPARATOR[data]
    first = ~gap
    first[1:] &= gap[:-1]
    last = ~gap
    last[:-1] &= gap[1:]
    # A row's first and last bytes also bound a word.
    lead = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[lead] = ~gap[lead]
    tail = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tail] = ~gap[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    table = _LOWER if lower else _SAME
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = int(np.searchsorted(ends, at + BLOCK, "right"))
        if j == i:  # a word longer than a block
            h = U(0)
            for b in range(at, int(ends[i]), BLOCK):
                part = table[data[b : min(b + BLOCK, int(ends[i]))]].astype(U) + U(1)
                h = mix(np.array([h + (part * _POW[: len(part)]).sum(dtype=U)], U))[0]
            out[i] = h
            i += 1
            continue
        stop = int(ends[j - 1])
        run = np.zeros(stop - at + 1, U)
        np.cumsum((table[data[at:stop]].astype(U) + U(1)) * _POW[: stop - at], out=run[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (run[e] - run[s]) * _INV[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93)
        i = j
    return mix(out), counts


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on, across rows too (see ``inside``)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n].copy()
    for j in range(1, k):
        out *= U(0xA24BAED4963EE407)
        out += h[j : j + n]
    return mix(out)


def inside(counts: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which of the k-grams that start at each word stay in one row."""
    n = max(total - k + 1, 0)
    out = np.ones(n, bool)
    if k > 1 and n:
        ends = np.cumsum(counts)[:-1]
        for j in range(1, k):
            bad = ends - j
            out[bad[(bad >= 0) & (bad < n)]] = False
    return out


def row_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)
