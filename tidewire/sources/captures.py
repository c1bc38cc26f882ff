"""Capture files (pcap and pcap-ng) as a DataFrame of frames.

Files are listed and read by Spark's own reader, so any store that Spark reaches will do; a
file is one row and so one task, because record lengths can only be followed from the start.
Captures are rotated at a size far below the reader's limit of 2 GB a file.  A file's frames
leave the task in batches of ``BATCH`` rows.

A file that breaks off gives the frames before the break and a last row with ``error`` set
and no frame; a file without any bytes gives no row.  Numbers count from 1 in each file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 4096
#: The longest frame, the block sizes of pcap-ng, and magic numbers by nanoseconds.
LONGEST, LEAST_BLOCK, MOST_BLOCK = 262_144, 12, 64 << 20
MAGIC = {0xA1B2C3D4: 1000, 0xA1B23C4D: 1}
SECTION, INTERFACE, SIMPLE, STATISTICS, ENHANCED = 0x0A0D0D0A, 1, 3, 5, 6

SCHEMA = T.StructType(
    [
        T.StructField("capture", T.StringType()),
        T.StructField("number", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("link_type", T.IntegerType()),
        T.StructField("interface", T.StringType()),
        T.StructField("frame", T.BinaryType()),
        T.StructField("cap_len", T.IntegerType()),
        T.StructField("orig_len", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)

Record = tuple[int, int, str, bytes, int]


class Broken(ValueError):
    """The file is no capture, or ends within a record."""


def classic(data: bytes) -> Iterator[Record]:
    """(ts_us, link type, interface, frame, original length) of each pcap record."""
    if len(data) < 24:
        raise Broken("short file header")
    order = next((o for o in "<>" if struct.unpack_from(o + "I", data)[0] in MAGIC), None)
    if order is None:
        raise Broken("not a capture")
    nanoseconds = MAGIC[struct.unpack_from(order + "I", data)[0]] == 1
    link = struct.unpack_from(order + "I", data, 20)[0] & 0xFFFF
    at = 24
    while at < len(data):
        if at + 16 > len(data):
            raise Broken("short record header")
        seconds, part, captured, original = struct.unpack_from(order + "4I", data, at)
        if captured > LONGEST:
            raise Broken("record too long")
        at += 16
        if at + captured > len(data):
            raise Broken("short record")
        yield seconds * 1_000_000 + (part // 1000 if nanoseconds else part), link, "", data[at : at + captured], original or captured
        at += captured


def _options(order: str, body: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "2H", body, at)
        if code == 0:
            return
        yield code, body[at + 4 : at + 4 + size]
        at += 4 + (size + 3) // 4 * 4


def blocks(data: bytes) -> Iterator[Record]:
    """The same of each pcap-ng packet block; interfaces count anew in each section."""
    order, at = "<", 0
    interfaces: list[tuple[int, str, int]] = []
    while at < len(data):
        if at + 12 > len(data):
            raise Broken("short block")
        if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            interfaces = []
        kind, size = struct.unpack_from(order + "2I", data, at)
        if not LEAST_BLOCK <= size <= MOST_BLOCK or at + size > len(data):
            raise Broken("bad block length")
        body = data[at + 8 : at + size - 4]
        at += size
        if kind == INTERFACE and len(body) >= 8:
            ticks, name = 1_000_000, ""
            for code, value in _options(order, body, 8):
                if code == 2:
                    name = value.decode("utf-8", "replace").rstrip("\0")
                elif code == 9 and value:
                    ticks = 1 << (value[0] & 127) if value[0] & 128 else 10 ** value[0]
            interfaces.append((struct.unpack_from(order + "H", body)[0], name, ticks))
        elif kind == ENHANCED and len(body) >= 20:
            which, high, low, captured, original = struct.unpack_from(order + "5I", body)
            if captured > len(body) - 20:
                raise Broken("short packet block")
            link, name, ticks = interfaces[which] if which < len(interfaces) else (1, "", 1_000_000)
            yield (high << 32 | low) * 1_000_000 // ticks, link, name, body[20 : 20 + captured], original or captured
        elif kind == SIMPLE and len(body) >= 4:
            original = struct.unpack_from(order + "I", body)[0]
            link, name, _ = interfaces[0] if interfaces else (1, "", 1)
            frame = body[4 : 4 + original]
            yield None, link, name, frame, original


def records(data: bytes) -> Iterator[Record]:
    yield from blocks(data) if data[:4] == b"\x0a\x0d\x0d\x0a" else classic(data)


def _rows(path: str, data: bytes) -> Iterator[tuple]:
    number = 0
    try:
        for number, (ts, link, name, frame, original) in enumerate(records(data), 1):
            yield path, number, ts, link, name, frame, len(frame), original, None
    except Broken as broken:
        yield path, number + 1, None, None, None, None, None, None, str(broken)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(SCHEMA)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows: list[tuple] = []
            for row in _rows(path, data.as_py()):
                rows.append(row)
                if len(rows) == BATCH:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Frames of all capture files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pcap,pcapng,cap}").load(path)
    return files.select("path", "content").mapInArrow(_batches, SCHEMA)


def good(frames: DataFrame) -> DataFrame:
    """Without the rows that tell of a break."""
    return frames.where(F.col("error").isNull()).drop("error")
