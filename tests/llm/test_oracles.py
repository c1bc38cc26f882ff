"""Queries of this package that have SQL give the same rows in DuckDB."""

from collections import Counter

import duckdb
import pytest

from tidewire.llm import entry, sharding

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = Counter(found.fetchall())
    assert want
    assert Counter(tuple(r[c] for c in columns) for r in entry.queries()[name](spark, SF).collect()) == want


def test_one_more_shard_takes_rows_only_into_itself(spark):
    from pyspark.sql import functions as F

    ids = spark.range(5000)
    for n in (40, 41, 42, 61):
        got = ids.select(sharding.assign(F.col("id"), sharding.ShardTree.of(n)).alias("a"), sharding.assign(F.col("id"), sharding.ShardTree.of(n + 1)).alias("b")).collect()
        assert all(b in (a, n) for a, b in got) and any(b == n for _, b in got)


def test_a_hot_row_is_dealt_out(spark):
    rows = spark.createDataFrame([(7, "same", k % 2) for k in range(3000)], "doc_id long, text string, part int").repartition(4)
    got = sharding.shard(rows).collect()
    assert sorted(r.slot for r in got) == list(range(3000)) and len({r.shard for r in got}) == 1
