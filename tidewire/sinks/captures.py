"""Frames written as pcap files: one writer per task, with rotation at a size.

``df.write.format("capture")`` streams a task's rows in the order they come, so
``repartitionByRange`` and ``sortWithinPartitions`` on the packet number decide what a file
holds.  A file is closed once its bytes reach the limit.  Tasks write hidden names that the
driver makes visible at commit; a task that is run again leaves no double rows.  The folder
must be one that driver and executors share.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

HEADER = struct.Struct("<IHHiIII")
SNAPLEN = 262_144


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder = options["path"].removeprefix("file:")
        self.base = options.get("base", "traffic")
        self.limit = int(options.get("rotate", "0"))
        self.nanoseconds = options.get("nanoseconds", "false").lower() == "true"
        self.overwrite = overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        part = task.partitionId() if task else 0
        os.makedirs(self.folder, exist_ok=True)
        names: list[tuple[str, str]] = []
        out, size = None, 0
        try:
            for row in iterator:
                if out is None:
                    ending = f"-{len(names)}" if names else ""
                    hidden = os.path.join(self.folder, f".{uuid.uuid4().hex}")
                    names.append((hidden, os.path.join(self.folder, f"{self.base}-{part:05d}{ending}.pcap")))
                    out = open(hidden, "wb")
                    out.write(HEADER.pack(0xA1B23C4D if self.nanoseconds else 0xA1B2C3D4, 2, 4, 0, 0, SNAPLEN, row.link_type))
                    size = HEADER.size
                seconds, rest = divmod(row.ts_us, 1_000_000)
                frame = bytes(row.frame)
                out.write(struct.pack("<4I", seconds, rest * 1000 if self.nanoseconds else rest, len(frame), row.orig_len))
                out.write(frame)
                size += 16 + len(frame)
                if self.limit and size >= self.limit:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            for name in os.listdir(self.folder):
                if name.startswith(f"{self.base}-") and name.endswith(".pcap"):
                    os.remove(os.path.join(self.folder, name))
        for message in messages:
            for hidden, name in message.names if message else []:
                os.replace(hidden, name)

    def abort(self, messages: list[Written | None]) -> None:
        for message in messages:
            for hidden, _ in message.names if message else []:
                if os.path.exists(hidden):
                    os.remove(hidden)


class CaptureSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def write(frames: DataFrame, folder: str, files: int = 1, rotate: int = 0, base: str = "traffic", nanoseconds: bool = False, mode: str = "append") -> None:
    """Frames by number into ``files`` ranges, each cut where it reaches ``rotate`` bytes."""
    spark: SparkSession = frames.sparkSession
    spark.dataSource.register(CaptureSink)
    ordered = frames.select("number", "ts_us", "link_type", "frame", "orig_len").repartitionByRange(files, "number").sortWithinPartitions("number")
    ordered.write.format("capture").mode(mode).option("path", folder).option("base", base).option("rotate", str(rotate)).option("nanoseconds", str(nanoseconds).lower()).save()
