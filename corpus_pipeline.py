"""Clean and pack a corpus: STAGES in order, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of
``documents``; the last returns one row per packed piece.

Null and empty texts pass the filters and are packed as their end id.  Of repeated rows, and
of an id with several texts, near-dedup keeps one row; rows with a null id stay unless another
row has their set of shingles.  Without labels the network calls nothing toxic; without
benchmark items nothing is contaminated; an empty table gives an empty result.  Other columns
are kept as they are, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, entry, neardup, packing, secretscan, toxicity
from tidewire.llm.common import shared_dir, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Distinct words whose ids a packing worker keeps: workers stay for all stages, and an idle one gives nothing back.
REMEMBERED = 150_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network calls toxic go; it is trained on labels of these documents."""
    small_batches(spark)
    return toxicity.drop(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity 0.8."""
    small_batches(spark)
    return neardup.drop(docs, neardup.Rule(shingle=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    small_batches(spark)
    return decontaminate.drop(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret values are replaced in the text, and n_chars follows; no document goes."""
    small_batches(spark)
    clean = secretscan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document, tokenised and packed into sequences."""
    small_batches(spark)
    return packing.digest(packing.pack(docs, entry.tokenizer_path(), remembered=REMEMBERED))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Training a network and byte-pair encoding are not SQL; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
