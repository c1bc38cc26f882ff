"""Drawing documents whose words are like those of a target, by importance weights and noise.

Words and their runs are hashed into a fixed number of buckets.  One pass counts each bucket
in all documents and in all target texts; the gains of the buckets are then an array of fixed
size, and a second pass looks up every feature of a document in it: the weight is their mean.
A score adds noise that only depends on seed and id, so drawing the highest scores is drawing
without replacement in proportion to the weights.

Scores are integers within a range that the gains bound, so their histogram is exact and
small.  Its counts are summed from the highest score down: that gives the rank at which each
score begins and the score at which the draw ends.  Only rows of surviving scores are numbered,
each within its score by id.

What repeats an id is alike in score; such rows are dealt out by where they lie in the written
table of scores and counted part by part before they are numbered, so no task holds them all.

Edge cases: a null or empty text has no words, weight 0, and is never drawn unless
``least_words`` is 0; a null id hashes like the empty text and sorts first; rows that repeat an
id are scored and ranked each; without target texts every bucket's gain compares with nothing
seen; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import checkpointed, ids_and_texts, map_batches, place
from tidewire.llm.textbatch import ALNUM, Words, word_chunks

BUCKETS = 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Rows that repeat an id are numbered in so many parts.
PARTS = 64
#: Features of more bytes are hashed one by one.
_LONG = 48

WEIGHED = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "n_words", "n_features", "weight")])


def _crc_table() -> np.ndarray:
    """Remainders of all bytes for the reflected polynomial of crc32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each byte range, all ranges byte by byte at once."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    out = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    long = int(np.searchsorted(-sizes, -_LONG))
    for k in range(int(min(_LONG, sizes[0])) if len(sizes) else 0):
        live = slice(long, int(np.searchsorted(-sizes, -k)))
        out[live] = _TABLE[(out[live] ^ data[starts[live] + k]) & np.uint32(255)] ^ (out[live] >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]])
    back = np.empty_like(out)
    back[order] = out
    return back


def _joined(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words joined by single spaces, and where each begins and ends there."""
    sizes = words.ends - words.starts
    begins = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64)
    at = np.arange(begins[-1]) - np.repeat(begins[:-1] - words.starts, sizes + 1)
    text = words.low[np.minimum(at, max(0, len(words.low) - 1))]
    text[begins[1:] - 1] = 0x20
    return text, begins[:-1], begins[:-1] + sizes


def features(words: Words, least: int, most: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of a run of words: the run's document and its bucket."""
    text, begins, ends = (words.low, words.starts, words.ends) if most == 1 else _joined(words)
    owners = words.owners()
    for n in range(least, most + 1):
        if words.n < n:
            return
        whole = owners[: words.n - n + 1] == owners[n - 1 :]
        yield owners[: len(whole)][whole], (crc32s(text, begins[: len(whole)][whole], ends[n - 1 :][whole]) % np.uint32(buckets)).astype(np.int64)


def counts(texts: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; each task sums its own before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, words in word_chunks(batch.column("text"), ALNUM):
                for _, found in features(words, least, most, buckets):
                    total += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in found.collect():  # a row for each bucket at most
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of how much likelier each bucket is in the target, smoothed by one."""
    all_raw, all_target = float(raw.sum() + len(raw)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * all_raw / ((s + 1) * all_target))) for s, t in zip(raw.tolist(), target.tolist())], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, least: int = 1, most: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and the floored mean gain of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_features, total = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
        for lo, hi, words in word_chunks(batch.column("text"), ALNUM):
            n_words[lo:hi] = words.counts
            for owner, found in features(words, least, most, len(gain)):
                n_features[lo:hi] += np.bincount(owner, minlength=hi - lo)
                # the sums lie far below 2**53, so they are exact in doubles
                total[lo:hi] += np.bincount(owner, gain[found], hi - lo).astype(np.int64)
        weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (n_words, n_features, weight))], [f.name for f in WEIGHED])

    return map_batches(ids_and_texts(docs), run, WEIGHED)


def scored(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """With ``score``: the weight and noise hashed from seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def rank(rows: DataFrame, drawn: int, histogram: list[tuple[int, int]]) -> DataFrame:
    """Rank of each row of a written table that is among the ``drawn`` highest scores, else null.

    ``histogram`` has (score, rows) of the rows that are ``eligible``.
    """
    scores = np.array(sorted(histogram, reverse=True), dtype=np.int64).reshape(-1, 2)
    sums = np.cumsum(scores[:, 1])
    surviving = int(np.searchsorted(sums, drawn)) + 1 if drawn else 0
    cut = int(scores[surviving - 1, 0]) if surviving else None
    survives = F.coalesce(F.col("eligible") & (F.col("score") >= F.lit(cut)), F.lit(False)) if surviving else F.lit(False)
    columns = ["doc_id", "n_features", "weight", "score"]
    others = rows.where(~survives).select(*columns, F.lit(None).cast("long").alias("rank"))
    if not surviving:
        return others
    # a number for each surviving score, and their range is bounded by the gains
    begins = rows.sparkSession.createDataFrame([(int(s), int(e - n)) for (s, n), e in zip(scores[:surviving], sums)], "score long, begins long")
    kept = rows.where(survives).select(*columns, F.pmod(place(), F.lit(PARTS)).alias("part"))
    alike = ["score", "doc_id", "n_features", "weight", "part"]
    spread = kept.withColumn("id_key", F.coalesce(F.xxhash64("doc_id"), F.lit(0))).repartition("score", "id_key", "part")
    counted = spread.groupBy(*alike).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_features", "weight", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(*alike, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy(*alike).orderBy(F.lit(1)))
    numbered = spread.withColumn("nth", nth).alias("r").join(offsets.alias("o"), [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in alike])
    numbered = numbered.select(*[f"r.{c}" for c in columns], (F.col("base") + F.col("nth")).alias("within")).join(F.broadcast(begins), "score")
    place_of = F.col("begins") + F.col("within")
    return numbered.select(*columns, F.when(place_of <= drawn, place_of).cast("long").alias("rank")).unionByName(others)


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, least: int = 1, most: int = 1, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; undrawn ones have no rank.

    Features are runs of ``least`` to ``most`` words.  Of the documents with ``least_words``
    words, ``percent`` in a hundred are drawn, rounded down.
    """
    gain = gains(counts(docs, least, most, buckets), counts(target, least, most, buckets))
    rows = scored(weigh(docs, gain, least, most), seed).withColumn("eligible", F.col("n_words") >= least_words)
    rows = checkpointed(rows.select("doc_id", "n_features", "weight", "score", "eligible"))
    histogram = [(r.score, r["n"]) for r in rows.where("eligible").groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()]
    return rank(rows, percent * sum(n for _, n in histogram) // 100, histogram)
