"""Columnar text helpers for Arrow tasks: a batch of texts becomes one byte array,
cut into words whose 64-bit hashes come from prefix sums, with no loop per word.

Words are runs of bytes other than space and ``\\x09-\\x0D``; UTF-8 continuation
bytes never fall in that set, so byte positions are safe cut points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Text a task works on at a time. Its hashes and sums take about 60 bytes for each byte.
CHUNK_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}
#: What a worker keeps from task to task, emptied by :func:`release`.
CACHES: list = [_powers]


def release(keep=None) -> None:
    """Empties the worker's caches (but for one) and hands freed memory back to the system. Workers
    serve one stage after the other, and an executor's limit counts all of them."""
    for cache in CACHES:
        if cache is not keep:
            cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run, keep=None):
    """A task function that starts and ends with empty caches; ``keep``: one that stays,
    because it is dear to fill and bounded."""
    def inside(batches):
        release(keep() if keep else None)
        try:
            yield from run(batches)
        finally:
            release(keep() if keep else None)
    return inside


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[base] = have
    return have[:n]


@dataclass
class Chunk:
    """Some consecutive rows of a batch: their text bytes and the row limits in them."""
    first_row: int
    data: np.ndarray      # uint8
    limits: np.ndarray    # int64, rows + 1

    @property
    def rows(self) -> int:
        return len(self.limits) - 1


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    return pc.fill_null(col, "")


def chunks(col: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Row ranges of about ``max_bytes`` of text (a longer text is a chunk of its own)."""
    n = len(col)
    if n == 0:
        return
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield Chunk(i, data[off[i]:off[j]], (off[i:j + 1] - off[i]).astype(np.int64))
        i = j


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte; other letters stay."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


@dataclass
class Words:
    """Words of a chunk in order; ``row_first[r]:row_first[r + 1]`` are those of row r."""
    start: np.ndarray
    end: np.ndarray
    row_first: np.ndarray

    @property
    def rows_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_first) - 1), np.diff(self.row_first))

    def __len__(self) -> int:
        return len(self.start)


def split_words(chunk: Chunk, extra_cuts: np.ndarray | None = None) -> Words:
    """Words of every row; ``extra_cuts[i]`` also begins a word at byte i (if it is
    not white space)."""
    data, limits = chunk.data, chunk.limits
    n = len(data)
    if n == 0:
        return Words(*(np.zeros(0, np.int64) for _ in range(2)), np.zeros(chunk.rows + 1, np.int64))
    space = (data == 32) | ((data >= 9) & (data <= 13))
    cut = np.zeros(n + 1, dtype=bool)
    cut[limits] = True
    if extra_cuts is not None:
        cut[:n] |= extra_cuts
    word = ~space
    begins = word.copy()
    begins[1:] &= space[:-1] | cut[1:n]
    ends = word.copy()
    ends[:-1] &= space[1:] | cut[1:n]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, limits).astype(np.int64))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: differences of one prefix sum, moved to a common
    origin, with the length mixed in."""
    n = len(data)
    prefix = np.empty(n + 1, dtype=U64)
    prefix[0] = 0
    np.cumsum(_BYTE_CODES[data] * powers(_BASE, n), out=prefix[1:])
    h = (prefix[end] - prefix[start]) * powers(_BASE_INV, n + 1)[start]
    return mix(h ^ ((end - start).astype(U64) << U64(40)))


def shingle_hashes(words: np.ndarray, row_first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words inside a row, and the row limits of them."""
    counts = np.diff(row_first)
    per_row = np.maximum(counts - k + 1, 0)
    first = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int64)
    if first[-1] == 0:
        return np.zeros(0, U64), first
    n = len(words) - k + 1
    run = np.zeros(n, dtype=U64)
    for i in range(k):
        run = run * U64(_BASE) + words[i:i + n]
    inside = np.repeat(row_first[:-1] - first[:-1], per_row) + np.arange(first[-1])
    return mix(run[inside]), first


def row_ids(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
