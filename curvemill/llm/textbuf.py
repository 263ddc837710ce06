"""Vectorised work on batches of UTF-8 texts: word bounds and 64-bit word hashes as numpy arrays.

A batch of an Arrow string column is one byte buffer with offsets. Everything here runs over that
buffer, never over single words, and over at most ``PIECE`` bytes of words at a time besides one or two
bytes of marks per byte of text, so one very long text costs memory in proportion to its own length only.
Hashes are 64-bit sums of random byte values times powers of an odd number, mixed at the end; unequal
words collide with a chance of 2^-64 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
BATCH_BYTES = 1 << 20
_MASK = (1 << 64) - 1

#: True for the six bytes of ASCII white space.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
WORD_BYTE = ~SPACE
#: True for the first byte of each code point.
CODE_POINT = (np.arange(256) & 0xC0) != 0x80


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(fold_case: bool, of: np.ndarray) -> np.ndarray:
    """Random values of the bytes that ``of`` marks, 0 for the others; A-Z as a-z if fold_case."""
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    if fold_case:
        values[65:91] = values[97:123]
    return np.where(of, values, np.uint64(0))


#: The odd base of the powers.
BASE = 0xD1342543DE82EF95


class _Powers:
    """Powers of an odd base modulo 2^64, as many as were ever needed."""

    def __init__(self) -> None:
        self.known = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            steps = np.full(max(n, 64), BASE, np.uint64)
            steps[0] = 1
            self.known = np.multiply.accumulate(steps)
        return self.known


_POWERS = _Powers()


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, at least."""
    return _POWERS.upto(n)


class Texts:
    """A batch of texts: data (bytes) and offsets (n + 1); nulls are empty texts."""

    def __init__(self, column: pa.Array | pa.ChunkedArray) -> None:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = pc.fill_null(column, "")
        column = column.cast(pa.large_string())
        _, at, data = column.buffers()
        self.n = len(column)
        if self.n:
            offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + self.n + 1]
        else:
            offsets = np.zeros(1, np.int64)
        low, high = int(offsets[0]), int(offsets[-1])
        self.data = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
        self.offsets = offsets - low

    def runs(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of marked bytes, which never cross texts; and each text's first run (n + 1)."""
        inside = of[self.data]
        first = np.zeros(len(inside) + 1, bool)
        first[self.offsets[:-1]] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | first[1:-1]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
        """64-bit hashes of the runs; the bytes between them must have value 0."""
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + PIECE)))
            base = starts[i]
            part = values[self.data[base : ends[j - 1]]]
            at = starts[i:j] - base
            length = np.diff(at, append=len(part))
            place = np.arange(len(part)) - np.repeat(at, length)
            part *= _POWERS.upto(int(length.max()))[place]
            out[i:j] = np.add.reduceat(part, at)
            i = j
        return mix64(out)

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked (marks: 256 booleans)."""
        total = np.concatenate(([0], np.cumsum(marks[self.data], dtype=np.int64)))
        return np.diff(total[self.offsets])


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` items in a row within one text, and the item each begins with."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ** 5) & _MASK | 1)
    room = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + size <= room)
    return mix64(out[at]), at


def pieces(batch: pa.RecordBatch, text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows with about ``most`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, side="right")))
        yield batch.slice(i, j - i)
        i = j


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What drops the things that a worker remembers from one task to the next.
FORGET: list[Callable[[], None]] = []


def forget() -> None:
    """Drops what tasks before have left in this worker."""
    for drop in FORGET:
        drop()


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], remembers: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives the memory it freed back to the system at its end: Python workers live on while other stages run.

    Unless it remembers things itself, it first drops what tasks of other steps have left in the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not remembers:
            forget()
        yield from work(batches)
        release()

    return run
