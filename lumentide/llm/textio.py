"""Vectorised word and shingle hashing over Arrow batches of texts.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``. Hashes are 64-bit
polynomials over a fixed random byte table, so equal words hash alike wherever they
stand, on every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a longer document is a pass of its own.
BLOCK_BYTES = 1 << 19

#: bytes that are hashed at once
_STRETCH = (1 << 20) - 2

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 20, 1 << int(n).bit_length())
    if size not in _powers:
        if size > 1 << 20:  # of one very long text; not kept
            return _cumulative_powers(_P, size), _cumulative_powers(_P_INV, size)
        _powers[size] = (_cumulative_powers(_P, size), _cumulative_powers(_P_INV, size))
    return _powers[size]


def _cumulative_powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    return x


class Words:
    """The words of a block of documents, as positions into one byte buffer."""

    __slots__ = ("buf", "starts", "ends", "bounds", "doc_bytes")

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        data = b"\n" + b"\n".join(t or b"" for t in texts) + b"\n"
        if lower:
            data = data.lower()
        self.buf = np.frombuffer(data, np.uint8)
        space = _SPACE[self.buf]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        #: byte offset of each document's first byte, and one past the last separator
        self.doc_bytes = np.concatenate(([1], 1 + np.cumsum(sizes + 1)))
        #: index of each document's first word; one more at the end
        self.bounds = np.searchsorted(self.starts, self.doc_bytes)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        """Index of the document of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word. A very long text is gone through in stretches, so that memory stays a few times its size."""
        out, at = [np.zeros(0, np.uint64)], 0
        while at < len(self.starts):
            begin = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, begin + _STRETCH, side="right")))
            out.append(range_hashes(_BYTE[self.buf[begin : self.ends[to - 1]]], self.starts[at:to] - begin, self.ends[at:to] - begin))
            at = to
        return np.concatenate(out)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs values[start:end], by running sums; equal runs hash alike wherever they stand. Overwrites ``values``."""
    powers, inverse = power_tables(len(values) + 1)
    values *= powers[: len(values)]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * inverse[starts])


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; entry i is of words i..i+n-1. Runs may cross documents."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, factor = words[:m].copy(), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(1, n):
            factor *= _Q
            out += words[k : k + m] * factor
    return mix(out)


def inside(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """Start positions of the runs of ``n`` words that lie within one document."""
    ok = np.zeros(total + 1, np.int32)
    counts = np.diff(bounds)
    has = counts >= n
    np.add.at(ok, bounds[:-1][has], 1)
    np.add.at(ok, bounds[1:][has] - n + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:total]) > 0)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cut Arrow batches into slices of about ``limit`` bytes of text; whole documents, nulls kept."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        column = column.cast(pa.large_binary())
        at, size, begin = 0, 0, 0
        sizes = [0 if n is None else n for n in pc.binary_length(column).to_pylist()]
        for at, n in enumerate(sizes):
            if at > begin and size + n > limit:
                yield batch.slice(begin, at - begin), column.slice(begin, at - begin).to_pylist()
                begin, size = at, 0
            size += n
        if len(sizes) > begin:
            yield batch.slice(begin), column.slice(begin).to_pylist()


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """One binary value for each row of a 2-D array."""
    width = matrix.shape[1] * matrix.itemsize
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * width
    data = np.ascontiguousarray(matrix).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def distinct_by_row(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, all in a row, and the rows' bounds. ``counts``: values of each row, one or more. Seven bits of a value tell rows apart, so it keeps 57."""
    out, bounds, at, ends = [values[:0]], [np.zeros(1, np.int64)], 0, np.cumsum(counts)
    for first in range(0, len(counts), 128):
        own = counts[first : first + 128]
        size, rows = int(own.sum()), np.repeat(np.arange(len(own), dtype=np.uint64), own)
        keys = (rows << np.uint64(57)) | (values[at : at + size] >> np.uint64(7))
        keys.sort()
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
        bounds.append(np.searchsorted(keys >> np.uint64(57), np.arange(1, len(own) + 1, dtype=np.uint64)) + bounds[-1][-1])
        out.append(keys & np.uint64((1 << 57) - 1))
        at = int(ends[first + len(own) - 1])
    return np.concatenate(out), np.concatenate(bounds)


def common_counts(x: np.ndarray, x_bounds: np.ndarray, y: np.ndarray, y_bounds: np.ndarray) -> np.ndarray:
    """How many values each two rows have in common: rows of ``distinct_by_row``, 128 at most, paired one by one."""
    rows = lambda b: np.repeat(np.arange(len(b) - 1, dtype=np.uint64), np.diff(b)) << np.uint64(57)
    both = np.concatenate((rows(x_bounds) | x, rows(y_bounds) | y))
    both.sort()
    same = both[1:][both[1:] == both[:-1]] >> np.uint64(57)
    return np.bincount(same.astype(np.int64), minlength=len(x_bounds) - 1)


def place_of(text: Column) -> Column:
    """A hash by which JVM joins tell texts of one id apart."""
    return F.xxhash64(text)
