"""Periodic runs of words: the Lyndon array of both orders, with matches that are used again.

For an order of the words, ``after[i]`` is the next place whose suffix is smaller than that of
``i``; the words between the two are the longest Lyndon word that starts at ``i``.  Every run
has such a word as its root in the order or in the reversed one, so runs are read off the
edges ``(i, after[i])`` and the length by which their two suffixes match.

The edges come from one pass with a chain of smaller suffixes.  Suffixes are compared word by
word; what is known of a match is never compared again: along a chain a match follows from
the one before it, and inside the match that reaches furthest right an edge has a copy, whose
match is its own unless it touches the end of what is known, from where on the words are
compared.  So every comparison moves that end or is the last of its pair, and the pass takes
time in proportion to the words.  Nothing but the order of two words is ever asked.

The left end of a run is found by comparing at most one period of words, and only for roots
whose right extension already makes the run long enough.

A run of exponent e holds each of its words about e times.  Texts are therefore first broken
at words that occur too rarely; no run that is asked for holds one of them.

Edge cases: a null or empty text has no words and no runs; repeated rows are searched each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import ids_and_texts, map_batches

#: Least words and least periods of a run.
LEAST_WORDS, LEAST_PERIODS = 6, 4

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN, False)),
        T.StructField("collapsed", T.StringType()),
    ]
)


def edges(a: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next place with a smaller suffix (else the length), and how far both match.

    ``a`` must be free of negative numbers; the end of the text is smaller than any of them.
    """
    n = len(a)
    a = [*a, -1]
    after, match = [n] * n, [0] * n
    # the last smaller suffix before each place, and how far both match
    before, alike = [-1] * n, [0] * n
    # a[first + k] == a[second + k] up to the end, the furthest right that is known
    first = second = end = 0
    for i in range(1, n):
        word, j, known = a[i], i - 1, 0
        if i >= end:
            other = a[j]
            while other > word:
                after[j] = i
                j = before[j]
                if j < 0:
                    break
                other = a[j]
            else:
                if other < word:
                    before[i] = j
                    continue
        while j >= 0:
            m = known
            if i < end and j >= second:
                at, copy = i - second + first, j - second + first
                if after[copy] == at:
                    m = max(m, match[copy])
                elif before[at] == copy:
                    m = max(m, alike[at])
                m = min(m, end - i)
            while a[j + m] == a[i + m]:
                m += 1
            if i + m >= end and m:
                first, second, end = j, i, i + m
            if a[j + m] < a[i + m]:
                before[i], alike[i] = j, m
                break
            # j's suffix is greater: so are those before it that differ from j's further on than m
            known = m
            while True:
                after[j], match[j] = i, m
                shared, j = alike[j], before[j]
                if shared <= m or j < 0:
                    break
            if j >= 0 and shared < m:
                before[i], alike[i] = j, shared
                break
    return after, match


def runs_of(ranks: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least so many words and periods, two at least."""
    if least_periods < 2:
        raise ValueError("a run has two periods at least")
    n, found = len(ranks), set()
    if n < 2:
        return found
    top = int(ranks.max())
    for order in (ranks.tolist(), (top - ranks).tolist()):
        after, match = edges(order)
        ends, reach = np.array(after), np.array(match)
        periods = ends - np.arange(n)
        for i in np.flatnonzero((ends < n) & (reach >= (least_periods - 2) * periods)).tolist():
            q = after[i] - i
            # a root one period before has the same run
            if i >= q and after[i - q] == i and match[i - q] == match[i] + q:
                continue
            left = 0
            while left < q and left < i and order[i - 1 - left] == order[after[i] - 1 - left]:
                left += 1
            length = left + q + match[i]
            if left < q and length >= max(least_words, least_periods * q):
                found.add((i - left, length, q))
    return found


def _stretches(ranks: np.ndarray, least_words: int, least_periods: int) -> list[tuple[int, int]]:
    """Stretches outside of which no run can lie, as they are broken at words that are too rare in them."""
    kept, found = np.ones(len(ranks), dtype=bool), [(0, len(ranks))]
    # each round looks at what the one before it left; more rounds than this seldom break more
    for _ in range(4):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], kept.view(np.int8), [0]])))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= least_words
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return []
        where = np.repeat(np.arange(len(starts)), ends - starts)
        at = np.arange(len(where)) + np.repeat(starts - np.concatenate([[0], np.cumsum(ends - starts)[:-1]]), ends - starts)
        _, which, count = np.unique(where * (int(ranks.max()) + 1) + ranks[at], return_inverse=True, return_counts=True)
        found = list(zip(starts.tolist(), ends.tolist()))
        rare = count[which] < least_periods
        if not rare.any():
            break
        kept[:] = False
        kept[at[~rare]] = True
    return found


def word_runs(words: list[bytes], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """Runs of a text's words by start, then period."""
    if len(words) < least_words:
        return []
    # places of the words in their order; only the order counts
    ranks = pc.rank(pa.array(words, pa.binary()), tiebreaker="dense").to_numpy().astype(np.int64)
    found = []
    for start, end in _stretches(ranks, least_words, least_periods):
        found += [(start + s, n, q) for s, n, q in runs_of(ranks[start:end], least_words, least_periods)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Without the words that a run contains after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        step[start + q] += 1
        step[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def find(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and the collapsed text of every row.

    Words are split at ASCII white space.  ``rewrite`` may change a document's words first.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc_ids = batch.column("doc_id").to_pylist()
        counts, sizes, flat, texts = [], [0], [], []
        for doc_id, text in zip(doc_ids, batch.column("text").to_pylist()):
            words = text.encode().split() if text else []
            if rewrite is not None:
                words = rewrite(doc_id, words)
            runs = word_runs(words, least_words, least_periods)
            counts.append(len(words))
            flat += runs
            sizes.append(len(flat))
            texts.append(b" ".join(collapse(words, runs)))
        columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
        structs = pa.StructArray.from_arrays(columns, fields=[pa.field(f.name, pa.int64(), False) for f in RUN])
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), structs, type=pa.list_(pa.field("element", structs.type, False)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())], [f.name for f in FOUND])

    return map_batches(ids_and_texts(docs), run, FOUND)


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, of every tenth document by checksum of its id with a tail that repeats itself.

    A null id counts as the empty text.
    """
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest of them, and checksums of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))

    def line(r: Column) -> Column:
        return F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))

    out = found.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
