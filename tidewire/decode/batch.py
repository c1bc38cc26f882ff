"""Many byte strings at once: an Arrow batch as one buffer, read at an offset for each row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Frames of one Arrow batch at most, so that a worker's memory follows neither the frames nor Spark's default of 10,000.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """At most ``BATCH_ROWS`` rows go to a Python worker at once; a smaller number that is set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def read_once(function):
    """A function that Spark must not evaluate a second time for a filter that it pushes below."""
    return function.asNondeterministic()


#: Bytes that may be read behind the last row without a check.
SLACK = 64


def given(values: pa.Array) -> np.ndarray:
    """The rows that are not null.  Like ``integers`` and ``numbers`` it keeps to buffers: what Arrow has for it loads pandas, a third of a worker's memory."""
    bits = values.buffers()[0]
    if bits is None:
        return np.ones(len(values), dtype=bool)
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=values.offset + len(values), bitorder="little")[values.offset :].astype(bool)


def integers(values: pa.Array, missing: int) -> np.ndarray:
    """Signed integers as 64 bits, with a number for null."""
    data = np.frombuffer(values.buffers()[1], f"i{values.type.bit_width // 8}")[values.offset : values.offset + len(values)] if len(values) else np.zeros(0)
    return np.where(given(values), data, missing).astype(np.int64)


def numbers(values: np.ndarray, kind: pa.DataType, where: np.ndarray | None = None) -> pa.Array:
    """Signed integers or truth values as Arrow, null but for the rows of ``where``."""
    bits = lambda flags: pa.py_buffer(np.packbits(flags.astype(bool), bitorder="little"))
    data = bits(values) if pa.types.is_boolean(kind) else pa.py_buffer(np.ascontiguousarray(values, dtype=f"i{kind.bit_width // 8}"))
    return pa.Array.from_buffers(kind, len(values), [None if where is None else bits(where), data])


class Bytes:
    """Rows of binary as a buffer with the begin and size of each; a null row has no bytes."""

    def __init__(self, values: pa.Array) -> None:
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        self.given = given(values)
        wide = pa.types.is_large_binary(values.type) or pa.types.is_large_string(values.type)
        n = len(values)
        if n:
            offsets = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
        else:
            offsets = np.zeros(1, np.int64)
        raw = values.buffers()[2] if n else None
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.data = np.concatenate([data, np.zeros(SLACK, np.uint8)])
        self.begin = offsets[:-1] - offsets[0]
        self.size = np.where(self.given, np.diff(offsets), 0)

    def __len__(self) -> int:
        return len(self.begin)

    def uint(self, at: np.ndarray | int, size: int = 1, rows: np.ndarray | None = None) -> np.ndarray:
        """Big-endian numbers at an offset of each row; 0 where they reach past the row's end."""
        begin, length = (self.begin, self.size) if rows is None else (self.begin[rows], self.size[rows])
        at = np.broadcast_to(np.asarray(at, dtype=np.int64), begin.shape)
        there = (at >= 0) & (at + size <= length)
        place = np.where(there, begin + at, 0)
        out = np.zeros(len(begin), dtype=np.int64)
        for k in range(size):
            out = out << 8 | self.data[place + k]
        return np.where(there, out, 0)

    def word_sums(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sums of the big-endian 16-bit words of a range of each row, an odd last byte counting as the high one."""
        total = np.zeros((2, len(self.data) + 1), dtype=np.int64)
        even = np.arange(len(self.data)) % 2 == 0
        total[0, 1:] = np.cumsum(np.where(even, self.data, 0))
        total[1, 1:] = np.cumsum(np.where(even, 0, self.data))
        first = self.begin + at
        last = first + np.maximum(size, 0)
        odd = first % 2
        high = total[odd, last] - total[odd, first]
        low = total[1 - odd, last] - total[1 - odd, first]
        return high * 256 + low


def folded(total: np.ndarray) -> np.ndarray:
    """One's-complement sums of sums of words."""
    for _ in range(3):
        total = (total & 0xFFFF) + (total >> 16)
    return total


def options(source: Bytes, at: np.ndarray, end: np.ndarray, rows: np.ndarray, header: int, pads: tuple[int, ...], last: int) -> tuple[np.ndarray, ...]:
    """(row, kind, offset of the value, its size) of type-length-value lists, all rows one option at a time.

    ``header`` is what a length counts besides its value; a pad is a kind without a length,
    and ``last`` ends a list.  A list that breaks off keeps what came before.
    """
    rows = np.asarray(rows)
    at, end = at.astype(np.int64)[rows], end.astype(np.int64)[rows]
    found: list[tuple[np.ndarray, ...]] = []
    while len(rows):
        going = at < end
        rows, at, end = rows[going], at[going], end[going]
        kind = source.uint(at, 1, rows)
        bare = np.isin(kind, (*pads, last))
        length = np.where(bare, 0, source.uint(at + 1, 1, rows))
        size = np.where(bare, 0, length - header)
        value = np.where(bare, at + 1, at + 2)
        whole = bare | ((at + 1 < end) & (size >= 0) & (value + size <= end))
        rows, at, end, kind, size, value = (x[whole] for x in (rows, at, end, kind, size, value))
        found.append((rows, kind, value, size))
        stays = kind != last
        rows, end, at = rows[stays], end[stays], (value + size)[stays]
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    flat = [np.concatenate(c) for c in zip(*found)]
    order = np.argsort(flat[0], kind="stable")
    return tuple(c[order] for c in flat)


def listed(rows: np.ndarray, n: int, items: pa.Array) -> pa.ListArray:
    """Items that belong to ascending rows, as a list for each of n rows."""
    offsets = np.searchsorted(rows, np.arange(n + 1))
    return pa.ListArray.from_arrays(numbers(offsets, pa.int32()), items)


def slices(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many ranges behind each other, and the offsets of each."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - begin, size)
    return data[at], offsets


def texts(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """Many ranges as text, each byte a character of ISO 8859-1."""
    raw, offsets = slices(data, begin, size)
    # bytes from 0x80 on take two bytes of UTF-8
    high = raw >= 0x80
    if high.any():
        where = np.arange(len(raw)) + np.concatenate([[0], np.cumsum(high)[:-1]])
        wide = np.empty(len(raw) + int(high.sum()), dtype=np.uint8)
        wide[where] = np.where(high, 0xC0 | raw >> 6, raw)
        wide[where[high] + 1] = 0x80 | raw[high] & 0x3F
        offsets = offsets + np.concatenate([[0], np.cumsum(high)])[offsets]
        raw = wide
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))).cast(pa.string())
