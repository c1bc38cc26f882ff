"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of (term, weight).  A block of candidates is turned into postings:
for each term the rows of the block that hold it and their weights.  A query walks its own
terms and scatters ``query weight * posting weights`` into one dense array of scores for the
block; a partition selection keeps the best k, and the lists of all blocks are merged.

Queries and candidates meet in blocks: queries are dealt to stripes of at most
``STRIPE_QUERIES`` and candidates to buckets of at most about ``BUCKET_ROWS``; each pair of a stripe
and a bucket is one group of bounded size.  Nothing is broadcast and no group grows with the
table.  Only the k best of each bucket and query leave a task.

Edge cases: vectors that are null, or hold a null or non-finite component, take no part;
terms beyond the shorter of two vectors count as zero; a query's own row is every row with
its vec_id; queries that repeat a whole row answer once; repeated candidates are ranked
each; fewer candidates than k give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
TOP = 10
STRIPE_QUERIES = 16_384
#: Rows of a bucket that a task holds as postings; a small table is dealt into more buckets, of a few rows at least.
BUCKET_ROWS, SMALL_BUCKET, FEW_BUCKETS = 65_536, 8192, 24


def whole_parts(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, weights): floor(scale * component) of the vectors that are finite throughout."""
    vec = F.col(vec_col)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    weights = F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.where(vec.isNotNull() & F.col(id_col).isNotNull()).where(~bad).select(F.col(id_col).cast("long").alias("vec_id"), weights.alias("weights"))


def postings(rows: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (rows that hold it, their weights)"""
    width = max(map(len, rows), default=0)
    dense = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        dense[i, : len(row)] = row
    out = {}
    for term in range(width):
        at = np.flatnonzero(dense[:, term])
        if len(at):
            out[term] = (at, np.ascontiguousarray(dense[at, term]))
    return out


def accumulate(query: np.ndarray, lists: dict[int, tuple[np.ndarray, np.ndarray]], scores: np.ndarray) -> np.ndarray:
    """Scatter the query's weighted postings into ``scores``, one term at a time."""
    scores[:] = 0
    for term in np.flatnonzero(query).tolist():
        if found := lists.get(term):
            at, weights = found
            if len(at) == len(scores):
                scores += query[term] * weights
            else:
                scores[at] += query[term] * weights
    return scores


def select_best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to the smaller id."""
    if len(scores) > k:
        least = -np.partition(-scores, k - 1)[k - 1]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search(vectors: DataFrame, is_query: Column, k: int = TOP, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k best rows by inner product."""
    rows = whole_parts(vectors, id_col, vec_col, scale)
    queries = rows.where(is_query).distinct().withColumn("query", F.xxhash64("vec_id", "weights"))
    n_rows, n_queries = vectors.count(), vectors.where(is_query).count()
    stripes = max(1, math.ceil(n_queries / STRIPE_QUERIES))
    buckets = max(1, math.ceil(n_rows / BUCKET_ROWS), min(FEW_BUCKETS, math.ceil(n_rows / SMALL_BUCKET)))
    dealt_queries = queries.withColumn("stripe", F.pmod("query", F.lit(stripes))).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    # the row's number within its partition deals equal rows out as evenly as others
    dealt_rows = rows.withColumn("bucket", F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).cast("int")).withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))))

    def block(wanted: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if wanted.empty or held.empty:
            return empty
        ids = held["vec_id"].to_numpy(np.int64)
        lists = postings(held["weights"].tolist())
        scores = np.zeros(len(ids), dtype=np.int64)
        parts = []
        for query, query_id, weights in zip(wanted["query"], wanted["vec_id"], wanted["weights"]):
            accumulate(np.asarray(weights, dtype=np.int64), lists, scores)
            others = np.flatnonzero(ids != query_id) if (ids == query_id).any() else slice(None)
            best = select_best(scores[others], ids[others], k)
            parts.append(pd.DataFrame({"query": query, "query_id": query_id, "vec_id": ids[others][best], "score": scores[others][best]}))
        return pd.concat(parts, ignore_index=True) if parts else empty

    found = dealt_queries.groupBy("stripe", "bucket").cogroup(dealt_rows.groupBy("stripe", "bucket")).applyInPandas(block, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
