"""Operators give the same whole results for inputs that come from a shuffle, and bounded samples of odd ones."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewire.llm import secretscan, sharding, toxicity
from tidewire.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ("deduplicated", "repartitioned", "repeated"))
def test_slots_of_shuffled_rows(spark, kind):
    docs = table(spark, SF, "documents")
    rows = {"deduplicated": docs.dropDuplicates(["doc_id"]), "repartitioned": docs.repartition(7), "repeated": docs.unionByName(docs).repartition(5)}[kind]
    placed = sharding.shard(rows)
    whole = placed.collect()
    assert len(whole) == docs.count() * (2 if kind == "repeated" else 1)
    # what is read of the result does not change it
    for found in (whole, placed.select("shard", "slot").collect()):
        slots = Counter((r.shard, r.slot) for r in found)
        sizes = Counter(r.shard for r in found)
        assert slots == Counter((s, k) for s, n in sizes.items() for k in range(n))


def test_sample_of_secrets_is_bounded(spark):
    repeated = spark.range(3000).select(F.lit(14).alias("doc_id"), F.lit("token = abcdefgh12345678 plain words").alias("text"))
    several = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    for docs in (repeated, several, repeated.limit(0)):
        models = secretscan.train(docs, sample_docs=50)
        assert models.is_random("x9Kq2LmZ81vTb7Rw0PdS") and not models.is_random("responsibilities")


def test_only_taken_texts_count():
    sizes = [(1, 10, 1, 500), (2, 11, 1, 40), (3, 12, 1, 70), (4, 13, 1, 60), (1, 20, 0, 900), (2, 21, 0, 800)]
    assert sorted(toxicity.taken(sizes, 100)) == [11, 13, 21]
    assert sorted(toxicity.taken(sizes, 5000)) == [10, 11, 12, 13, 20, 21]
    assert toxicity.taken([], 10) == []
