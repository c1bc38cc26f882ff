"""Vectorised word work on batches of texts.

A batch is the UTF-8 buffer of an Arrow string array, so every step below is one numpy
pass over bytes and no Python object is made per word.  Bytes from 0x80 on are word bytes
in both word rules used here, so working on bytes and on code points gives the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; temporary arrays take about 40 times as much.
CHUNK_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_WORD_STEP = 0xD6E8FEB86659FD93
_U = np.uint64


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()

#: Everything but white space: ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Digits, small letters and everything beyond ASCII, after lower-casing A-Z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            for name, factor in (("up", _MULTIPLIER), ("down", _inverse(_MULTIPLIER))):
                steps = np.full(size, factor, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and len+1 offsets into them; null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    raw = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32) if len(texts) else np.zeros(1, np.int32)
    offsets = raw[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of some texts: byte ranges, 64-bit hashes and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> None:
        self.low = LOWER[data]
        self.offsets = offsets
        inside = word_bytes[self.low]
        n = len(data)
        before = np.zeros(n, dtype=bool)
        after = np.zeros(n, dtype=bool)
        if n:
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            begins, ends = offsets[:-1], offsets[1:]
            full = ends > begins
            before[begins[full]] = False
            after[ends[full] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)  # word range of text i: first[i]..first[i+1]
        self.counts = np.diff(self.first)

    @property
    def n(self) -> int:
        return len(self.starts)

    def owners(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        up, down = _POWERS.upto(len(self.low) + 1)
        total = np.zeros(len(self.low) + 1, dtype=np.uint64)
        np.cumsum((self.low.astype(np.uint64) + _U(1)) * up[: len(self.low)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def text(self, first: int, last: int) -> bytes:
        """Words first..last-1, joined by one blank."""
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.starts[first:last], self.ends[first:last]))


def window_hashes(words: np.ndarray, sizes: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For every wanted window size, the hash of each run of so many consecutive words."""
    total = np.zeros(len(words), dtype=np.uint64)
    step = 1
    for k in range(1, max(sizes, default=0) + 1):
        if k > len(words):
            return
        total = total[: len(words) - k + 1] + words[k - 1 :] * _U(step)
        step = step * _WORD_STEP % (1 << 64)
        if k in sizes:
            yield k, mix(total + _U(k))


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def word_chunks(texts: pa.Array, word_bytes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    data, offsets = utf8_parts(texts)
    for lo, hi in chunks(offsets, limit):
        part = offsets[lo : hi + 1]
        yield lo, hi, Words(data[part[0] : part[-1]], part - part[0], word_bytes)
