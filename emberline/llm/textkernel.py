"""Vectorised text kernels over Arrow string buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; each gets a 64-bit
hash. All functions work on blocks of whole rows, cut so that a block holds at
most ``BLOCK_BYTES`` bytes (a single longer text is a block of its own), which
bounds the memory of a Python worker whatever the size of an Arrow batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, size: int, name: str) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below size; the largest table is kept up to a block's size."""
    table = _powers.get(name)
    if table is None or len(table) < size:
        with np.errstate(over="ignore"):
            table = np.full(max(size, 1 << 16), base, np.uint64)
            table[0] = 1
            table = np.cumprod(table, dtype=np.uint64)
        if len(table) <= 2 * BLOCK_BYTES:
            _powers[name] = table
    return table[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x = x * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and its len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """Yields (first row, bytes, offsets from 0) of runs of rows of at most ``limit`` bytes."""
    data, offsets = flat(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the index of its first word (len + 1 entries)."""
    inside = ~SEPARATOR[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    start[cuts] = inside[cuts]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    end[tails] = inside[tails]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each non-empty span; equal bytes have equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        terms = _BYTE[data]
        terms *= _power(_BASE, len(data), "base")
        total = np.cumsum(terms, dtype=np.uint64)
        h = total[ends - 1] - total[starts] + terms[starts]
        h *= _power(_BASE_INVERSE, len(data), "inverse")[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a block, and the index of each text's first word."""
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(LOWER[data], starts, ends), first


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and the index of each text's first run.

    A text of fewer words has one run, its whole sequence; a text without words has none.
    """
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    at = np.zeros(len(first), np.int64)
    np.cumsum(runs, out=at[1:])
    out = np.zeros(int(at[-1]), np.uint64)
    if not len(out):
        return out, at
    with np.errstate(over="ignore"):
        pad = np.concatenate([hashes, np.zeros(size, np.uint64)])
        weights = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        weights |= np.uint64(1)
        full = np.zeros(len(hashes), np.uint64)
        for k in range(size):
            full += pad[k : k + len(hashes)] * weights[k]
        long = counts >= size
        keep = np.repeat(first[:-1] - at[:-1], runs) + np.arange(len(out))
        out[:] = full[keep]
        for d in np.flatnonzero((counts > 0) & ~long):
            s = np.uint64(counts[d])
            for k in range(int(counts[d])):
                s += hashes[first[d] + k] * weights[k]
            out[at[d]] = s * np.uint64(0x9FB21C651E98DF25)
    return mix(out), at


def release() -> None:
    """Gives memory that a task no longer uses back to the machine; workers serve later tasks too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(task):
    """``task``, an iterator over batches, with ``release`` at its end."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            release()

    return run


def take(batch: pa.RecordBatch, first: int, count: int, names: list[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)).slice(first, count) for n in names]
