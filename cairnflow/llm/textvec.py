"""Vectorised views of text columns: bytes, words, hashes of words and of word sequences.

A batch of texts is one byte array with a start and an end for each text. Everything here works on
whole arrays and cuts long inputs into pieces, so the working memory beyond the batch is bounded.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute, in workers too)

#: Bytes that separate words: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_PIECE = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1


def trim() -> None:
    """Gives freed memory back to the system: workers live on between stages, side by side."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def lean(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``f`` of a group, trimming the worker's memory after it."""

    @functools.wraps(f)
    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        trim()
        return out

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, _PIECE + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), _PIECE + 1)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[o[0] : o[-1]]  # a slice shares the buffer of its batch
    starts, ends = o[:-1] - o[0], o[1:] - o[0]
    if column.null_count:
        gone = ~np.asarray(column.is_valid())
        ends[gone] = starts[gone]
    return raw, starts, ends


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have at most ``most`` bytes, or one row each."""
    _, starts, ends = buffers(batch.column(text))
    total = np.cumsum(ends - starts)
    i, n = 0, batch.num_rows
    while i < n:
        done = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + most, "right")))
        yield batch.slice(i, j - i)
        i = j
    trim()


def word_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text (and past the last) its first word; ``outside``: which bytes separate words."""
    if not len(starts) or ends[-1] <= starts[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts) + 1, np.int64)
    a, b = int(starts[0]), int(ends[-1])
    word = ~outside[data[a:b]]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    full = ends > starts
    s, e = starts[full] - a, ends[full] - a
    first[s] = word[s]
    last[e - 1] = word[e - 1]
    if (gap := starts[1:] > ends[:-1]).any():  # bytes that belong to no text
        for x, y in zip(ends[:-1][gap] - a, starts[1:][gap] - a, strict=True):
            first[x:y] = last[x:y] = False
    ws = np.flatnonzero(first) + a
    return ws, np.flatnonzero(last) + a + 1, np.concatenate([np.searchsorted(ws, starts), [len(ws)]])


def word_hashes(data: np.ndarray, ws: np.ndarray, we: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words, equal for equal bytes (after A-Z are lower-cased, with ``lower``)."""
    out = np.empty(len(ws), np.uint64)
    values = _VALUE[LOWER] if lower else _VALUE
    i, n = 0, len(ws)
    while i < n:
        j = int(np.searchsorted(we, ws[i] + _PIECE, "right"))
        if j <= i:  # a word longer than a piece
            out[i] = _long_hash(data[ws[i] : we[i]], values)
            i += 1
            continue
        a, b = int(ws[i]), int(we[j - 1])
        p = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[data[a:b]] * _POW[: b - a], out=p[1:])
        out[i:j] = (p[we[i:j] - a] - p[ws[i:j] - a]) * _INV[ws[i:j] - a]
        i = j
    return mix(out ^ (we - ws).astype(np.uint64) * np.uint64(_BASE))


def _long_hash(raw: np.ndarray, values: np.ndarray) -> np.uint64:
    total, scale = 0, 1
    for k in range(0, len(raw), _PIECE):
        part = raw[k : k + _PIECE]
        total += int((values[part] * _POW[: len(part)]).sum(dtype=np.uint64)) * scale
        scale = scale * pow(_BASE, len(part), 1 << 64) % (1 << 64)
    return np.uint64(total % (1 << 64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words (by doubling); fewer than ``k`` words have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    grams: dict[int, np.ndarray] = {1: words}

    def of(m: int) -> np.ndarray:
        if m not in grams:
            h = m // 2
            a, b = of(m - h), of(h)
            size = len(words) - m + 1
            grams[m] = mix(a[:size] * np.uint64(0xD6E8FEB86659FD93) + b[m - h : m - h + size] + np.uint64(m))
        return grams[m]

    return of(k)[:n]
