"""Token ids in files of bit planes.

``write`` orders documents by id, tokenises them and writes one file for each task; ``read``
gives the documents back, many tasks to a file.  Both are a Spark data source.

A file is a row of chunks and an index.  A chunk holds a fixed number of ids, transposed:
plane b has bit b (or byte b) of every id, and each plane is compressed with zstandard by
itself, so the planes of high bits shrink to almost nothing and none is stored above the
highest bit in use.  Beside the planes a chunk has ids and lengths of the documents that begin
in it.  The index, one fixed record for each chunk, lies at the end: sizes of the planes, ids
before the chunk, and where its first document begins.  A reader therefore opens a file
anywhere, and a document may run over any number of chunks.

    file    magic, chunks, index records, tail
    chunk   planes, documents (id, length, whether there is an id), all compressed
    tail    number of chunks, offset of the index, magic

A task writes a file of a name of its own; the commit on the driver writes ``manifest.json``
with the names and sizes of the files that count, in order.  Files of lost or repeated tasks
are named nowhere.  Paths may be of any store that ``pyarrow.fs`` opens by URI.

Edge cases: a null or empty text is the end id alone; a null id comes first and is read back
as null; rows that repeat an id lie side by side, in order of their texts' checksums; an empty
table gives a manifest without ids and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tidewire.llm.common import checkpointed, ids_and_texts, place
from tidewire.llm.packing import END_ID, encoder

#: Ids of a chunk, and chunks that a task reads.
CHUNK, STEP = 1 << 16, 32
MAGIC = b"TWPLANE1"
LEVEL = 3
#: Copies of a row that take more bytes than this together are dealt out to several tasks.
HOT_BYTES = 64 << 20
MOST_PLANES = 32
INDEX = np.dtype([("offset", "<i8"), ("ids_before", "<i8"), ("first_doc", "<i8"), ("n_ids", "<i4"), ("n_docs", "<i4"), ("docs_size", "<i4"), ("width", "<i4"), ("sizes", "<i4", (MOST_PLANES,))])
TAIL = np.dtype([("chunks", "<i8"), ("index", "<i8"), ("magic", "S8")])

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])


def to_planes(ids: np.ndarray, width: int) -> list[bytes]:
    """The ids' bits (width 1) or bytes (width 8) by place, lowest first, up to the highest in use."""
    n = -(-int(ids.max()).bit_length() // width) if len(ids) else 0
    if width == 8:
        by_id = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [by_id[:, k].tobytes() for k in range(n)]
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(n)]


def from_planes(planes: Sequence[bytes], n: int, width: int) -> np.ndarray:
    ids = np.zeros(n, dtype=np.uint32)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, dtype=np.uint8)
        part = raw if width == 8 else np.unpackbits(raw, count=n)
        ids |= part.astype(np.uint32) << np.uint32(k * width)
    return ids


class ChunkWriter:
    """Writes one file; holds one chunk of ids and the index."""

    def __init__(self, out, width: int = 1, chunk: int = CHUNK) -> None:
        import zstandard

        self.out, self.width, self.chunk = out, width, chunk
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.index: list[tuple] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.n_docs = 0
        self.docs: list[tuple[int | None, int, int]] = []
        out.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n_ids + self.n_held, len(ids)))
        self.n_docs += 1
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.chunk:
            whole = np.concatenate(self.held)
            full = len(whole) // self.chunk * self.chunk
            for k in range(0, full, self.chunk):
                self._flush(whole[k : k + self.chunk])
            self.held, self.n_held = [whole[full:]], len(whole) - full

    def _flush(self, ids: np.ndarray) -> None:
        end = self.n_ids + len(ids)
        begin = [d for d in self.docs if d[1] < end]
        self.docs = self.docs[len(begin) :]
        planes = [self.pack(p) for p in to_planes(ids, self.width)]
        there = np.array([d[0] is not None for d in begin], dtype=np.uint8)
        table = np.array([d[0] or 0 for d in begin], dtype="<i8").tobytes() + np.array([d[2] for d in begin], dtype="<i8").tobytes() + there.tobytes()
        docs = self.pack(table)
        for part in (*planes, docs):
            self.out.write(part)
        sizes = [len(p) for p in planes]
        self.index.append((self.at, self.n_ids, begin[0][1] if begin else end, len(ids), len(begin), len(docs), self.width, sizes + [0] * (MOST_PLANES - len(sizes))))
        self.at += sum(sizes) + len(docs)
        self.n_ids = end

    def close(self) -> None:
        if self.n_held:
            self._flush(np.concatenate(self.held))
        self.out.write(np.array(self.index, dtype=INDEX).tobytes())
        self.out.write(np.array([(len(self.index), self.at, MAGIC)], dtype=TAIL).tobytes())


class ChunkReader:
    """Documents of a file that begin in a range of its chunks."""

    def __init__(self, source) -> None:
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        size = source.size()
        tail = np.frombuffer(source.read_at(TAIL.itemsize, size - TAIL.itemsize), dtype=TAIL)[0]
        if tail["magic"] != MAGIC:
            raise ValueError("not a file of token planes")
        self.index = np.frombuffer(source.read_at(int(tail["chunks"]) * INDEX.itemsize, int(tail["index"])), dtype=INDEX)

    def _chunk(self, k: int) -> tuple[np.ndarray, bytes]:
        entry = self.index[k]
        sizes = [int(s) for s in entry["sizes"] if s]
        raw = self.source.read_at(sum(sizes) + int(entry["docs_size"]), int(entry["offset"]))
        ends = np.cumsum([0, *sizes]).tolist()
        planes = [self.unpack(raw[a:b]) for a, b in zip(ends, ends[1:])]
        return from_planes(planes, int(entry["n_ids"]), int(entry["width"])), self.unpack(raw[ends[-1] :])

    def documents(self, first: int, last: int) -> Iterator[list[tuple[int | None, int, np.ndarray]]]:
        """(doc_id, start in the file, ids) of the documents that begin in chunks first..last-1, in batches."""
        waiting: list[tuple[int | None, int, int]] = []
        held: list[np.ndarray] = []
        base = int(self.index["ids_before"][first]) if first < len(self.index) else 0
        for k in range(first, len(self.index)):
            if k >= last and not waiting:
                return
            ids, docs = self._chunk(k)
            held.append(ids)
            end = int(self.index["ids_before"][k]) + len(ids)
            if k < last:
                n = int(self.index["n_docs"][k])
                doc_ids, sizes, there = np.frombuffer(docs, "<i8", n), np.frombuffer(docs, "<i8", n, 8 * n), np.frombuffer(docs, np.uint8, n, 16 * n)
                starts = int(self.index["first_doc"][k]) + np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64) if n else []
                waiting += [(d if t else None, s, size) for d, t, s, size in zip(doc_ids.tolist(), there.tolist(), map(int, starts), sizes.tolist())]
            whole = next((i for i, (_, s, size) in enumerate(waiting) if s + size > end), len(waiting))
            if whole or not waiting:
                known = np.concatenate(held)
                if whole:
                    yield [(d, s, known[s - base : s - base + size]) for d, s, size in waiting[:whole]]
                waiting = waiting[whole:]
                keep = waiting[0][1] if waiting else end
                held, base = [known[keep - base :]], keep


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    ids: int
    docs: int
    chunks: int
    size: int


@dataclass
class Range(InputPartition):
    name: str
    start: int
    first: int
    last: int


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.tokenizer = options["path"], options["tokenizer"]
        self.width, self.chunk = {"bit": 1, "byte": 8}[options.get("planes", "byte")], int(options.get("chunk", CHUNK))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written | None:
        from pyspark import TaskContext

        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        name = f"part-{part:05d}-{uuid.uuid4().hex}.planes"
        tokens = encoder(self.tokenizer)
        with store.open_output_stream(f"{folder}/{name}") as out:
            writer = ChunkWriter(out, self.width, self.chunk)
            for batch in iterator:
                texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(texts)):
                    writer.add(doc_id, np.append(ids, np.uint32(END_ID)).astype(np.uint32))
            writer.close()
        return Written(part, name, writer.n_ids, writer.n_docs, len(writer.index), writer.at)

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        store, folder = _store(self.path)
        with store.open_output_stream(f"{folder}/manifest.json") as out:
            out.write(json.dumps({"format": MAGIC.decode(), "files": [m.__dict__ for m in files if m.docs]}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{folder}/{m.name}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.ids = options["path"], options.get("ids", "true").lower() == "true"
        self.step = int(options.get("step", STEP))

    def partitions(self) -> Sequence[Range]:
        store, folder = _store(self.path)
        with store.open_input_stream(f"{folder}/manifest.json") as source:
            files = json.loads(source.read())["files"]
        found, start = [], 0
        for f in files:
            found += [Range(f["name"], start, k, min(k + self.step, f["chunks"])) for k in range(0, f["chunks"], self.step)]
            start += f["ids"]
        return found or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, folder = _store(self.path)
        with store.open_input_file(f"{folder}/{partition.name}") as source:
            for docs in ChunkReader(source).documents(partition.first, partition.last):
                raw = [ids.astype("<u4").tobytes() for _, _, ids in docs]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d for d, _, _ in docs], pa.int64()),
                        pa.array([partition.start + s for _, s, _ in docs], pa.int64()),
                        pa.array([len(ids) for _, _, ids in docs], pa.int64()),
                        pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                        pa.array(raw if self.ids else [None] * len(docs), pa.binary()),
                    ],
                    [f.name for f in SCHEMA],
                )


class TokenPlanes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_planes"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def _ordered(docs: DataFrame, hot_bytes: int) -> DataFrame:
    """Rows in ranges of ids; equal rows are told apart only where many of them would meet in one range."""
    rows = ids_and_texts(docs).withColumn("crc", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    alike = rows.groupBy("doc_id", "crc").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16)).alias("size"))
    keys = ["doc_id", "crc"]
    if not alike.where((F.col("n") > 1) & (F.col("size") > hot_bytes)).isEmpty():
        rows = checkpointed(rows).withColumn("place", place())
        keys = [*keys, "place"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")


def write(docs: DataFrame, path: str, tokenizer_path: str, planes: str = "byte", chunk: int = CHUNK, hot_bytes: int = HOT_BYTES) -> None:
    """Ids of all texts, each document closed by the end id, in ascending order of doc_id."""
    spark = docs.sparkSession
    spark.dataSource.register(TokenPlanes)
    _ordered(docs, hot_bytes).write.format("token_planes").mode("append").option("path", path).option("tokenizer", tokenizer_path).option("planes", planes).option("chunk", str(chunk)).save()


def read(spark: SparkSession, path: str, ids: bool = False, step: int = STEP) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, the ids (little-endian unsigned 32-bit)."""
    spark.dataSource.register(TokenPlanes)
    return spark.read.format("token_planes").option("path", path).option("ids", str(ids).lower()).option("step", str(step)).load()
