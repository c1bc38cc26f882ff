"""Benchmark decontamination.

Normalised n-grams of the benchmark form a hash set that is broadcast; every partition scans
the word windows of its documents against it, checks each hit on the words themselves, and
reports the hit word ranges and the items they come from.  Documents are never shuffled.

The broadcast is bounded: a set takes some five times the text of its items, and a benchmark
beyond ``limit_bytes`` of text is split by item into parts of about that size (an item is one
row and stays whole).  The documents then pass one scan after another, each with one part
and each written before the next, so that no worker ever holds two.

A window is ``n`` consecutive words of an item; an item of fewer words, but not none, is one
window.  Words: A-Z lower-cased, then runs of digits, a-z and everything beyond ASCII.

Edge cases: a null or empty text has no words, hence no hit; items that are null, empty or
without an id take no part; repeated items count once; rows that repeat a document are each
reported; other columns are ignored by :func:`scan` and kept by :func:`drop` and :func:`cut`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import boxed, checkpointed, ids_and_texts, map_batches
from tidewire.llm.textbatch import ALNUM, Words, utf8_parts, window_hashes, word_chunks

WINDOW = 10
#: Bytes of benchmark text that one broadcast may hold.
LIMIT_BYTES = 16 << 20
_FILTER_BITS = 20
#: Windows whose items a worker remembers.
_REMEMBERED = 1000

RANGE = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])


class NgramSet:
    """Window hashes of the items, behind a small bitmap, and the words that decide in the end.

    Held as arrays: per word of the items some 6 bytes of text, its bounds and item, and the
    hash and place of the window that begins there; about 30 bytes a word, whatever repeats.
    """

    def __init__(self, items: list[tuple[str, str]], n: int = WINDOW) -> None:
        self.items = [item for item, _ in items]
        low, starts, ends, owner = [], [], [], []
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        n_bytes = n_words = 0
        for lo, _, words in word_chunks(pa.array([text for _, text in items], pa.string()), ALNUM):
            own, sizes = words.owners(), np.minimum(n, words.counts)
            for k, hashes in window_hashes(words.hashes(), set(sizes[sizes > 0].tolist())):
                first = own[: len(hashes)]
                at = np.flatnonzero((first == own[k - 1 :]) & (sizes[first] == k))
                found.setdefault(k, []).append((hashes[at], (at + n_words).astype(np.uint32)))
            low.append(words.low)
            starts.append((words.starts + n_bytes).astype(np.uint32))
            ends.append((words.ends + n_bytes).astype(np.uint32))
            owner.append((own + lo).astype(np.uint32))
            n_bytes, n_words = n_bytes + len(words.low), n_words + words.n
        joined = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((low, np.uint8), (starts, np.uint32), (ends, np.uint32), (owner, np.uint32))]
        self.low, self.starts, self.ends, self.owner = joined
        #: By window size: distinct hashes, where the places of each begin, and the places (first words).
        self.windows, self.maps = {}, {}
        for k, parts in found.items():
            hashes, places = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            distinct, first = np.unique(hashes[order], return_index=True)
            self.windows[k] = (distinct, np.append(first, len(places)), places[order])
            self.maps[k] = np.zeros(1 << _FILTER_BITS, dtype=bool)
            self.maps[k][distinct >> np.uint64(64 - _FILTER_BITS)] = True
        self._recent: dict[tuple[int, int], dict[bytes, list[str]]] = {}

    def owners(self, k: int, window: int) -> dict[bytes, list[str]]:
        """The items of one hash, by their words; a few are remembered."""
        if (k, window) not in self._recent:
            _, first, places = self.windows[k]
            out: dict[bytes, set[int]] = {}
            for p in places[first[window] : first[window + 1]].tolist():
                text = b" ".join(self.low[s:e].tobytes() for s, e in zip(self.starts[p : p + k], self.ends[p : p + k]))
                out.setdefault(text, set()).add(int(self.owner[p]))
            if len(self._recent) >= _REMEMBERED:
                self._recent.clear()
            self._recent[k, window] = {t: sorted({self.items[i] for i in x}) for t, x in out.items()}
        return self._recent[k, window]

    def hits(self, words: Words) -> list[tuple[int, int, list[str]]]:
        """(first word, number of words, items) of each window of the texts that is one of the items'."""
        out = []
        if not self.windows or not words.n:
            return out
        owners = words.owners()
        for k, found in window_hashes(words.hashes(), set(self.windows)):
            likely = np.flatnonzero(self.maps[k][found >> np.uint64(64 - _FILTER_BITS)])
            if not len(likely):
                continue
            distinct = self.windows[k][0]
            at = np.searchsorted(distinct, found[likely])
            at[at == len(distinct)] = 0
            same = (distinct[at] == found[likely]) & (owners[likely] == owners[likely + k - 1])
            for i, window in zip(likely[same].tolist(), at[same].tolist()):
                if items := self.owners(k, window).get(words.text(i, i + k)):
                    out.append((i, k, items))
        return out


def _scan_schema(columns: T.StructType) -> T.StructType:
    return T.StructType(
        [
            *columns,
            T.StructField("_words", T.LongType()),
            T.StructField("_ranges", T.ArrayType(RANGE)),
            T.StructField("_items", T.ArrayType(T.StringType())),
        ]
    )


def _points(low: np.ndarray, base: int, at: int) -> int:
    """Code points from byte ``base`` to byte ``at``."""
    part = low[base:at]
    return int(len(part) - np.count_nonzero((part & 0xC0) == 0x80))


def _scan_part(df: DataFrame, ngrams: NgramSet) -> DataFrame:
    """Add hit ranges and items of one part of the benchmark to what earlier parts found."""
    context = df.sparkSession.sparkContext
    shared = context.broadcast(ngrams)
    names = [c for c in df.columns if c not in ("_words", "_ranges", "_items")]
    schema = _scan_schema(T.StructType([df.schema[c] for c in names]))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        ngrams = shared.value
        rows = batch.num_rows
        n_words = np.zeros(rows, dtype=np.int64)
        ranges: list[list] = [[] for _ in range(rows)]
        items: list[list] = [[] for _ in range(rows)]
        texts = batch.column("row").field("text")
        _, offsets = utf8_parts(texts)
        for lo, hi, words in word_chunks(texts, ALNUM):
            n_words[lo:hi] = words.counts
            hits = ngrams.hits(words)
            if not hits:
                continue
            edge = np.zeros(words.n + 1, dtype=np.int64)
            owners = words.owners()
            for first, k, found in hits:
                edge[first] += 1
                edge[first + k] -= 1
                items[lo + owners[first]].extend(found)
            covered = np.cumsum(edge[:-1]) > 0
            # a run also ends where a document ends
            heads = words.first[:-1][words.counts > 0]
            step = np.diff(covered.astype(np.int8), prepend=0)
            begin = covered & (step == 1)
            begin[heads] = covered[heads]
            firsts = np.flatnonzero(begin)
            last = np.zeros(words.n, dtype=bool)
            last[:-1] = covered[:-1] & (~covered[1:] | begin[1:])
            last[-1] = covered[-1]
            for a, b in zip(firsts.tolist(), np.flatnonzero(last).tolist()):
                doc = int(owners[a])
                base = int(offsets[lo + doc] - offsets[lo])
                ranges[lo + doc].append({"first": a - int(words.first[doc]), "last": b + 1 - int(words.first[doc]), "begin": _points(words.low, base, int(words.starts[a])), "end": _points(words.low, base, int(words.ends[b]))})
        if "_ranges" in batch.schema.names:
            for i, (r, x) in enumerate(zip(batch.column("_ranges").to_pylist(), batch.column("_items").to_pylist())):
                ranges[i], items[i] = union(r + ranges[i]), x + items[i]
        arrays = [batch.column(c) for c in names]
        arrays += [pa.array(n_words), pa.array(ranges, pa.list_(pa.struct([(f.name, pa.int64()) for f in RANGE]))), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, [*names, "_words", "_ranges", "_items"])

    return map_batches(df, scan, schema)


def union(ranges: list[dict]) -> list[dict]:
    """Disjoint ranges that cover the same words."""
    out: list[dict] = []
    for r in sorted(ranges, key=lambda r: (r["first"], r["last"])):
        if out and r["first"] < out[-1]["last"]:
            if r["last"] > out[-1]["last"]:
                out[-1] = out[-1] | {"last": r["last"], "end": r["end"]}
        else:
            out.append(r)
    return out


def _annotated(docs: DataFrame, benchmark: DataFrame, n: int, limit_bytes: int) -> DataFrame:
    """The rows as one struct ``row``, their number of words, hit ranges and items."""
    usable = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = usable.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    parts = 1 + int(size // limit_bytes)
    out = boxed(docs)
    for part in range(parts):
        chosen = usable if parts == 1 else usable.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        out = _scan_part(out, NgramSet([(r.item_id, r.text) for r in chosen.toLocalIterator()], n))
        if part < parts - 1:
            out = checkpointed(out)
    return out


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """doc_id, n_words, ranges (words first..last-1, code points begin..end-1) and items of each row."""
    found = _annotated(ids_and_texts(docs), benchmark, n, limit_bytes)
    return found.select("row.doc_id", F.col("_words").alias("n_words"), F.col("_ranges").alias("ranges"), F.col("_items").alias("items"))


def drop(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """The documents without a hit, all their columns as they were."""
    return _annotated(docs, benchmark, n, limit_bytes).where(F.size("_ranges") == 0).select("row.*")


def cut(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """All documents, with the hit spans taken out of their text."""
    found = _annotated(docs, benchmark, n, limit_bytes)
    text = F.col("row.text")
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
    cleaned = F.aggregate(
        "_ranges",
        start,
        lambda acc, r: F.struct(F.concat(acc["kept"], F.substring(text, (acc["at"] + 1).cast("int"), (r["begin"] - acc["at"]).cast("int"))).alias("kept"), r["end"].alias("at")),
        lambda acc: F.concat(acc["kept"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647))),
    )
    clean = F.when(F.size("_ranges") > 0, cleaned).otherwise(text)
    return found.select(*[clean.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """The report of :func:`scan` as counts and one hash of the items."""
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("ranges") > 0).alias("contaminated"),
    )


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
