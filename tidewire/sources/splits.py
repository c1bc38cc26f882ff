"""Large classic capture files, read by many tasks.

Records of a classic file can only be followed from the start, so a file is read in two
passes.  The first cuts it at byte ranges; each task looks for a place in its range where a
chain of plausible records begins, follows them to the end of the range and says where it
began, where it ended and how many records it saw.  The driver, with one row for each range,
checks that every range begins where the one before it ended; a range that does not (because
a frame holds what looks like records) is followed again from the right place.  The second
pass reads the records of each range from its exact place, with their numbers.

So rows are those of :func:`tidewire.sources.captures.read`, whatever the frames hold.  Files of
other formats are a range each and must fit a task's memory.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.sources.captures import BATCH, LONGEST, MAGIC, SCHEMA, Broken, records

#: Bytes of a range, of one read, and records that a chain must have to be believed.
RANGE, READ, CHAIN = 128 << 20, 4 << 20, 6
HEADER = 24
_RANGE = "path string, size long, low long, high long, start long"
_SEEN = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("n", T.LongType()), T.StructField("classic", T.BooleanType())])


class Window:
    """Reads of a file at any place, some megabytes at once."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
        self.file = store.open_input_file(name)
        self.size = self.file.size()
        self.at, self.data = 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes; fewer only at the end of the file."""
        if at < self.at or at + n > self.at + len(self.data):
            self.at, self.data = at, self.file.read_at(max(n, READ), at)
        return self.data[at - self.at : at - self.at + n]

    def order(self) -> tuple[str, bool, int] | None:
        """Byte order, whether times are in nanoseconds, and link type of a classic file; None for any other."""
        head = self.get(0, HEADER)
        for order in "<>":
            if len(head) == HEADER and (magic := struct.unpack_from(order + "I", head)[0]) in MAGIC:
                return order, MAGIC[magic] == 1, struct.unpack_from(order + "I", head, 20)[0] & 0xFFFF
        return None


def _plausible(window: Window, at: int, order: str, nanoseconds: bool) -> bool:
    """Whether a chain of records begins at a place, or fewer that end with the file."""
    for _ in range(CHAIN):
        if at == window.size:
            return True
        head = window.get(at, 16)
        if len(head) < 16:
            return False
        _, part, captured, original = struct.unpack(order + "4I", head)
        if captured > LONGEST or part >= (1_000_000_000 if nanoseconds else 1_000_000) or (original and original < captured) or at + 16 + captured > window.size:
            return False
        at += 16 + captured
    return True


def _follow(window: Window, start: int, high: int, order: str) -> tuple[int, int]:
    """Where the first record at or behind ``high`` begins, and how many come before it; a break counts as one."""
    at, n = start, 0
    while at < high and at < window.size:
        head = window.get(at, 16)
        captured = struct.unpack_from(order + "I", head, 8)[0] if len(head) == 16 else LONGEST + 1
        n += 1
        if captured > LONGEST or at + 16 + captured > window.size:
            return window.size, n
        at += 16 + captured
    return at, n


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            window = Window(row["path"])
            known = window.order()
            if known is None:
                # the first range of another format stands for the whole file
                rows.append({**row, "start": 0, "stop": row["size"] if row["low"] == 0 else 0, "n": 0, "classic": False})
                continue
            order, nanoseconds, _ = known
            start = row["start"]
            if start is None:
                start = HEADER if row["low"] == 0 else next((at for at in range(row["low"], min(row["high"], row["size"])) if _plausible(window, at, order, nanoseconds)), row["high"])
            stop, n = _follow(window, start, row["high"], order)
            rows.append({**row, "start": start, "stop": stop, "n": n, "classic": True})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(f.name, pa.string() if f.name == "path" else pa.bool_() if f.name == "classic" else pa.int64()) for f in _SEEN]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(SCHEMA)
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    for batch in batches:
        for row in batch.to_pylist():
            rows: list[tuple] = []
            for found in _records(Window(row["path"]), row):
                rows.append(found)
                if len(rows) == BATCH:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)


def _records(window: Window, row: dict) -> Iterator[tuple]:
    path, number = row["path"], row["before"]
    try:
        if not row["classic"]:
            for ts, link, name, frame, original in records(window.get(0, window.size)):
                number += 1
                yield path, number, ts, link, name, frame, len(frame), original, None
            return
        order, nanoseconds, link = window.order()
        at = row["start"]
        while at < row["high"] and at < window.size:
            head = window.get(at, 16)
            if len(head) < 16:
                raise Broken("short record header")
            seconds, part, captured, original = struct.unpack(order + "4I", head)
            if captured > LONGEST:
                raise Broken("record too long")
            frame = window.get(at + 16, captured)
            if len(frame) < captured:
                raise Broken("short record")
            number += 1
            yield path, number, seconds * 1_000_000 + (part // 1000 if nanoseconds else part), link, "", frame, captured, original or captured, None
            at += 16 + captured
    except Broken as broken:
        yield path, number + 1, None, None, None, None, None, None, str(broken)


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """path, size, low, high, start, stop, n, classic and records before each range: one row for each task of :func:`read`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pcap,pcapng,cap}").load(path).select("path", F.col("length").alias("size"))
    cuts = files.select("path", "size", F.explode(F.expr(f"sequence(0L, greatest(size - 1, 0L), {size}L)")).alias("low"))
    asked = cuts.select("path", "size", "low", F.least(F.col("low") + size, "size").alias("high"), F.lit(None).cast("long").alias("start")).collect()
    known: dict[tuple[str, int], dict] = {}
    # a second round is only needed where a frame looks like records; each settles one range of a file at least
    while asked:
        df = spark.createDataFrame([tuple(r) for r in asked], _RANGE).repartition(len(asked))
        for r in df.mapInArrow(_seen, _SEEN).collect():  # a few numbers for each range
            known[r.path, r.low] = r.asDict()
        asked, last = [], {}
        for (name, _), r in sorted(known.items()):
            stop = last.get(name)
            if r["classic"] and stop is not None and r["start"] != stop and not (r["n"] == 0 and stop >= r["high"]):
                asked.append((r["path"], r["size"], r["low"], r["high"], stop))
                last[name] = None
            elif r["classic"]:
                last[name] = None if name in last and stop is None else max(r["stop"], stop or 0)
    out, before = [], {}
    for (name, _), r in sorted(known.items()):
        if r["stop"] > r["start"]:
            out.append((*[r[c] for c in ("path", "size", "low", "high", "start", "stop", "n", "classic")], before.get(name, 0)))
        before[name] = before.get(name, 0) + r["n"]
    return spark.createDataFrame(out, "path string, size long, low long, high long, start long, stop long, n long, classic boolean, before long")


def read(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Frames of all capture files under a path, each range of a file by a task of its own."""
    found = ranges(spark, path, size)
    return found.repartition(max(1, found.count())).mapInArrow(_read, SCHEMA)
