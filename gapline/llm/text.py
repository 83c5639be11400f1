"""Vectorised words of whole texts, on Arrow arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 24 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows, so that a slice has about `max_bytes` of `column` (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        limit = (ends[start - 1] if start else 0) + max_bytes
        stop = max(start + 1, int(np.searchsorted(ends, limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, and how many each text has (null: 0)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full, min_count=0).as_py():  # white space at an end leaves an empty part
        mask = full.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(mask)])
        stops = np.cumsum(counts)
        counts = ends[stops] - ends[stops - counts]
        flat = flat.filter(full)
    return flat, counts


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's index in the list of distinct words, and that list."""
    d = pc.dictionary_encode(flat)
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64 bits (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(32)
    return x
