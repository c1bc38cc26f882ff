"""A task of a decoded query keeps few Python workers, and each of them few frames."""

import pytest

import __spark_entry__
from tidewire.decode.batch import BATCH_ROWS

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("name", ["decode_tls", "decode_ethernet", "decode_filter_fields", "decode_arp", "decode_udp", "checksum_verify"])
def test_three_python_nodes_and_small_batches(spark, name):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, 10_000)
    try:
        df = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(KEY)) == BATCH_ROWS
        # a node that encodes, one that finds the headers and one that walks the bodies
        assert df._jdf.queryExecution().executedPlan().toString().count("EvalPython") <= 3
        spark.conf.set(KEY, 500)
        __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(KEY)) == 500
    finally:
        spark.conf.set(KEY, before)


@pytest.mark.parametrize("name", ["decode_arp", "decode_udp"])
def test_two_python_nodes_where_no_body_is_walked(spark, name):
    df = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("EvalPython") <= 2
