"""Vectorised work on the UTF-8 bytes of an Arrow text column.

Documents are handled as one byte array plus offsets, so that words, lines and
windows of a whole batch are found and hashed by a few numpy passes.  All hashes
are 64-bit polynomials modulo 2**64 over random byte values, finalised by a mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_VALUE = mix64(np.arange(1, 257, dtype=U64) * U64(_BASE))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, U64), np.full(size, pow(_BASE, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least n of them."""
    size = 1 << max(20, int(n).bit_length())
    return _powers(size)


def released(run: Callable) -> Callable:
    """A function of Arrow batches that gives the memory it no longer needs back when its task ends; workers are used again."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if _powers.cache_info().currsize > 1:
            _powers.cache_clear()
        pa.default_memory_pool().release_unused()
        _trim()

    return wrapped


@lru_cache(maxsize=1)
def _trimmer() -> Callable | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None  # another C library


def _trim() -> None:
    if (trim := _trimmer()) is not None:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges of at most `most` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def owners(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row that each byte position lies in; empty rows own nothing."""
    return np.searchsorted(offsets, positions, "right") - 1


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; none crosses a row's start."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = offsets[:-1][offsets[:-1] < n]
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    before[first] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    after[first[first > 0] - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def finish(raw: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """The hash of slices from their polynomials and lengths."""
    if isinstance(size, int):
        return mix64(raw + U64(size * 0xD6E8FEB86659FD93 & _MASK))
    return mix64(raw + size * U64(0xD6E8FEB86659FD93))


class Hasher:
    """Hashes of any slices of one byte array."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, U64)
        np.cumsum(BYTE_VALUE[data] * self.up[: len(data)], out=self.prefix[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.prefix[ends] - self.prefix[starts]) * self.down[starts]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return finish(self.raw(starts, ends), (ends - starts).astype(U64))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every k neighbours; shorter by k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(k):
        out = (out ^ hashes[i : i + n]) * U64((0xA0761D6478BD642F + 2 * i * 0x2545F4914F6CDD1D) & _MASK | 1)
        out ^= out >> U64(29)
    return mix64(out)
