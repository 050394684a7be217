"""Whole texts of an Arrow batch as flat byte, word and shingle arrays.

Words are runs of bytes other than space and 0x09-0x0D. Everything is computed over one flat buffer
per slice of a batch, so the Python cost does not depend on the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked on at a time; one longer text is worked on alone.
SLICE_BYTES = 1 << 20

#: Each byte with A-Z lower-cased.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` text bytes, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at, before = 0, 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, before + (most or SLICE_BYTES), "right")))
            yield batch.slice(at, to - at)
            at, before = to, int(ends[to - 1])


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets, also where there are none."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run ends at a row's end."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(inside) + 1, bool)
    first[offsets[:-1]] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    starts = np.flatnonzero(begin)
    # a run stops at the first byte outside, or where the next row begins
    stop = np.append(~inside, True)
    stop |= first
    stop[-1] = True
    stops = np.flatnonzero(stop)
    return starts, stops[np.searchsorted(stops, starts, "right")]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans, regardless of A-Z case if ``lower``.

    Eight bytes at a time go, with the number of their block, through ``mix``, which is not linear: no pattern of
    repeated or swapped parts makes two spans collide more often than chance does.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data] if lower else data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    sizes = ends - starts
    blocks = -(-sizes // 8)
    firsts = np.cumsum(blocks) - blocks
    number = np.arange(int(blocks.sum())) - np.repeat(firsts, blocks)
    at = np.repeat(starts, blocks) + 8 * number
    left = np.minimum(np.repeat(ends, blocks) - at, 8).astype(np.uint64)
    # bytes behind the end of the span count as zero; its length tells them from bytes of the text
    value = eight[at] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left))
    value = mix(value ^ mix(number.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    out = np.zeros(len(starts), np.uint64)
    some = np.flatnonzero(blocks)
    if len(some):
        out[some] = np.add.reduceat(value, firsts[some])
    return mix(out + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """The words of a slice: byte spans, row of each, and the first word of each row (n + 1 entries)."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = True) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, lower)


def words(column: pa.Array) -> Words:
    data, offsets = flat(column)
    starts, ends = runs(~_SPACE[data], offsets)
    first = np.searchsorted(starts, offsets)
    return Words(data, offsets, starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows within a row, and the first window of each row (n + 1 entries).

    A row of fewer than k words, but at least one, has one window: its whole sequence.
    """
    counts = np.diff(first)
    full = np.maximum(counts - k + 1, (counts > 0).astype(counts.dtype))
    starts = np.concatenate([[0], np.cumsum(full)])
    if not len(hashes):
        return np.zeros(0, np.uint64), starts
    row = np.repeat(np.arange(len(counts)), full)
    at = first[row] + np.arange(len(row)) - starts[row]
    out = np.zeros(len(row), np.uint64)
    factor = 1
    for j in range(k):
        factor = (factor * 0xC6A4A7935BD1E995 + 0x2545F4914F6CDD1D) % 2**64
        inside = at + j < first[row + 1]
        out += np.where(inside, hashes[np.minimum(at + j, len(hashes) - 1)], np.uint64(0)) * np.uint64(factor | 1)
    return mix(out + np.minimum(counts, k)[row].astype(np.uint64)), starts


def distinct_windows(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct window hashes in ascending order, and the first of each row (n + 1 entries)."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[keep], row[keep]
    return hashes, np.searchsorted(row, np.arange(len(starts)))


def lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32), pa.int32()), pa.array(values, kind))
