"""Numbers, addresses and names out of BINARY columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.decode.batch import Bytes, numbers


def built_once(build: Callable[[], dict[str, Column]]) -> Callable[[], dict[str, Column]]:
    """Columns by name, put together once for each JVM and not for each query."""
    made: dict[int, dict[str, Column]] = {}

    def get() -> dict[str, Column]:
        from pyspark import SparkContext

        key = id(SparkContext._gateway)
        if key not in made:
            made[key] = build()
        return made[key]

    return get


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _at(offset: int | Column) -> Column:
    return (F.lit(offset) if isinstance(offset, int) else offset).cast("int")


def part(data: Column, offset: int | Column, size: int | Column) -> Column:
    """Bytes from an offset counted from 0; past the end there are none."""
    return F.substring(data, _at(offset) + 1, _at(size))


def rest(data: Column, offset: int | Column) -> Column:
    return F.substring(data, _at(offset) + 1, F.lit(2147483647))


def uint(data: Column, offset: int | Column, size: int) -> Column:
    """Big-endian unsigned number, NULL where the bytes are not all there."""
    piece = part(data, offset, size)
    return F.when(F.octet_length(piece) == size, F.conv(F.hex(piece), 16, 10).cast("long"))


def small(data: Column, offset: int | Column, size: int = 1) -> Column:
    return uint(data, offset, size).cast("int")


def mac(data: Column, offset: int | Column) -> Column:
    piece = part(data, offset, 6)
    return F.when(F.octet_length(piece) == 6, F.regexp_replace(F.lower(F.hex(piece)), "(..)(?=.)", "$1:"))


def address(data: Column, offset: int | Column, version: int) -> Column:
    """Struct of text and key; IPv4 text by built-in functions, IPv6 text by an Arrow function."""
    size = 4 if version == 4 else 16
    piece = part(data, offset, size)
    key = F.concat(F.lit(f"0{version}"), F.lower(F.hex(piece)))
    text = F.concat_ws(".", *[F.conv(F.hex(F.substring(piece, i, 1)), 16, 10) for i in range(1, 5)]) if version == 4 else ipv6_text(piece)
    return F.when(F.octet_length(piece) == size, F.struct(text.alias("text"), key.alias("key")))


def ipv6_text(piece: Column) -> Column:
    """Sixteen bytes as text: groups without leading zeros, the first longest run of two zero groups or more as ``::``."""
    groups = F.regexp_replace(F.regexp_replace(F.lower(F.hex(piece)), "(....)(?=.)", "$1:"), "(^|:)0{1,3}(?=[0-9a-f])", "$1")
    out = groups
    for n in range(2, 9):
        zeros = rf"(^|:)0(:0){{{n - 1}}}(:|$)"
        out = F.when(groups.rlike(zeros), F.regexp_replace(groups, rf"^(.*?){zeros}", "$1::")).otherwise(out)
    return F.regexp_replace(out, ":::+", "::")


@F.arrow_udf(T.LongType())
def word_sum(data: pa.Array) -> pa.Array:
    """Sum of the big-endian 16-bit words, an odd last byte counting as the high one: one pass over a batch."""
    rows = Bytes(data)
    return numbers(rows.word_sums(np.zeros(len(rows), dtype=np.int64), rows.size), pa.int64(), rows.given)


def folded(total: Column) -> Column:
    """One's-complement sum of a sum of words."""
    for _ in range(3):
        total = total.bitwiseAND(F.lit(0xFFFF)) + F.shiftrightunsigned(total, 16)
    return total


def latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")
