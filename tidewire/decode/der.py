"""DER elements of a whole Arrow batch at once.

Every element of every row is found by cursors that move together: a cursor stands at an
element, the next round stands at its sibling and, if it is constructed, at its first child.
What comes out is the tree of each row as a flat list in depth-first order, so fields are
looked up by parent and place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.decode.batch import Bytes, listed, read_once

#: Values of extensions are octet strings that hold DER themselves; they are opened where they hold one whole element.
OCTETS, CONSTRUCTED, DEEPEST = 0x04, 0x20, 16
ELEMENT = T.StructType([T.StructField(n, T.IntegerType(), False) for n in ("parent", "nth", "tag", "at", "size")])


def _heads(source: Bytes, rows: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(fits, tag, begin and size of the value) of the elements at some offsets; lengths are definite, of four bytes at most."""
    tag, first = source.uint(at, 1, rows), source.uint(at + 1, 1, rows)
    more = np.where(first >= 0x80, first & 0x7F, 0)
    size = first.copy()
    for n in range(1, 5):
        of = more == n
        size[of] = source.uint(at[of] + 2, n, rows[of])
    value = at + 2 + more
    fits = (at + 2 <= end) & (first != 0x80) & (more <= 4) & (tag & 0x1F != 0x1F) & (value + size <= end)
    return fits, tag, value, size


def _tree(source: Bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    rows = np.flatnonzero(source.size > 1)
    count = len(rows)
    at, end = np.zeros(count, dtype=np.int64), source.size[rows]
    parent, nth, depth = np.full(count, -1), np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
    found, made = [], 0
    while len(rows):
        fits, tag, value, size = _heads(source, rows, at, end)
        rows, at, end, parent, nth, depth, tag, value, size = (x[fits] for x in (rows, at, end, parent, nth, depth, tag, value, size))
        name = made + np.arange(len(rows))
        made += len(rows)
        found.append((rows, name, parent, nth, tag, value, size))
        inner_fits, _, inner, inner_size = _heads(source, rows, value, value + size)
        wraps = (tag == OCTETS) & inner_fits & (inner + inner_size == value + size) & (source.uint(value, 1, rows) & CONSTRUCTED != 0)
        opens = ((tag & CONSTRUCTED != 0) | wraps) & (size > 0) & (depth < DEEPEST)
        goes = (value + size < end) & (depth > 0)
        rows = np.concatenate([rows[opens], rows[goes]])
        parent = np.concatenate([name[opens], parent[goes]])
        nth = np.concatenate([np.zeros(int(opens.sum()), dtype=np.int64), nth[goes] + 1])
        depth = np.concatenate([depth[opens] + 1, depth[goes]])
        at, end = np.concatenate([value[opens], (value + size)[goes]]), np.concatenate([(value + size)[opens], end[goes]])
    row, name, parent, nth, tag, value, size = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 7
    # an element begins before what it holds, so the order of begins is depth-first
    order = np.lexsort((-size, value, row))
    begins = np.searchsorted(row[order], np.arange(len(source)))
    place = np.empty(made, dtype=np.int64)
    place[name[order]] = np.arange(made) - begins[row[order]]
    up = np.where(parent >= 0, place[parent], -1) if made else parent
    return row[order], [x[order] for x in (up, nth, tag, value, size)]


class Tree:
    """The elements of all rows, with look-ups for many elements at once; -1 stands for none."""

    def __init__(self, source: Bytes) -> None:
        self.source = source
        self.row, (up, self.nth, self.tag, self.at, self.size) = _tree(source)
        begins = np.searchsorted(self.row, np.arange(len(source)))
        there = np.bincount(self.row, minlength=len(source)) > 0
        self.root = np.where(there, begins, -1)
        self.up = np.where(up >= 0, begins[self.row] + up, -1)
        # a fan is at most as wide as a row has bytes
        self.width = int(source.size.max(initial=0)) + 1
        key = np.where(self.up >= 0, self.up * self.width + self.nth, -1)
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def child(self, parent: np.ndarray, nth: np.ndarray | int) -> np.ndarray:
        wanted = parent * self.width + nth
        where = np.minimum(np.searchsorted(self.keys, wanted), max(0, len(self.keys) - 1))
        if not len(self.keys):
            return np.full(len(parent), -1, dtype=np.int64)
        return np.where((parent >= 0) & (self.keys[where] == wanted), self.order[where], -1)

    def children(self, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``parent``, element) of all children, in order."""
        known = parent >= 0
        first, last = np.searchsorted(self.keys, np.where(known, parent, 0) * self.width), np.searchsorted(self.keys, np.where(known, parent, 0) * self.width + self.width)
        n = np.where(known, last - first, 0)
        which = np.repeat(np.arange(len(parent)), n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return which, self.order[first[which] + nth]

    def tagged(self, element: np.ndarray, tag: int) -> np.ndarray:
        """The elements that have a tag, the others as -1."""
        return np.where((element >= 0) & (self._of(self.tag, element) == tag), element, -1)

    def _of(self, column: np.ndarray, element: np.ndarray) -> np.ndarray:
        return np.where(element >= 0, column[np.maximum(element, 0)], -1) if len(column) else np.full(len(element), -1)

    def tags(self, element: np.ndarray) -> np.ndarray:
        return self._of(self.tag, element)

    def values(self, element: np.ndarray) -> list[bytes | None]:
        data, begin = self.source.data, self.source.begin
        return [data[begin[self.row[e]] + self.at[e] : begin[self.row[e]] + self.at[e] + self.size[e]].tobytes() if e >= 0 else None for e in element.tolist()]


@read_once
@F.arrow_udf(T.ArrayType(ELEMENT, False))
def elements(ders: pa.Array) -> pa.Array:
    """The elements of each DER value, depth first; what breaks off is left out with all that follows it."""
    source = Bytes(ders)
    row, columns = _tree(source)
    items = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns], fields=[pa.field(f.name, pa.int32(), False) for f in ELEMENT])
    return listed(row, len(source), items)
