"""Cutting Arrow batches of texts into slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at once; a longer single text is a slice of its own.
SLICE_BYTES = 8_000_000

_libc = ctypes.CDLL(None)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with at most ``limit`` bytes in ``column``; behind the last, memory that Arrow and the C library keep unused is freed."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last
    # a worker outlives its task, and what it keeps would be missing in the stages that follow
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


_kept: dict[str, object] = {}


def worker_keeps(name: str, make: Callable[[], object] = object) -> object:
    """What a worker keeps under ``name`` from task to task; what it kept under another name, for an earlier stage, goes."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts of a batch, null as empty, with 64-bit offsets."""
    whole = batch.column(column).cast(pa.large_string())
    # a copy of its own: ascii_lower misreads a slice that shares its parent's buffers
    return pc.fill_null(whole.take(pa.array(np.arange(len(whole)))), "")


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between ASCII white space, and for each the row it is from."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    rows = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    filled = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not filled.all():
        words, rows = words.filter(pa.array(filled)), rows[filled]
    return words, rows


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1 of all i, one after another."""
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(len(shift)) + shift
