"""Streams give what the batch operators give once all windows have passed; exports keep every row."""

from pyspark.sql import functions as F

from tidewire.operators import flows as W
from tidewire.plans.bridge import packets
from tidewire.sinks import exports
from tidewire.streaming import traffic

SF = "/root/testdata/sf0.001"


def run(df, spark, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name)


def source(spark, tmp_path):
    """All packets in order, then one with addresses far later, so that every window passes."""
    df = packets(spark, SF)
    folder = str(tmp_path / "in")
    df.coalesce(1).write.parquet(folder)
    late = df.where("src_ip is not null").limit(1).withColumn("ts_us", F.col("ts_us") + F.lit(400 * 86_400_000_000))
    late.coalesce(1).write.mode("append").parquet(folder)
    return df, traffic.stream(spark, folder, df.schema)


def test_windows(spark, tmp_path):
    df, live = source(spark, tmp_path)
    got = run(traffic.per_window(live, "1 hour", late="100 days"), spark, "windows", tmp_path)
    hour = F.expr("ts_us div 3600000000") * 3_600_000
    wanted = df.groupBy(hour.alias("start_ms"), "protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("frame_len").cast("long")).alias("bytes"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_flow_sessions(spark, tmp_path):
    df, live = source(spark, tmp_path)
    got = run(traffic.flow_sessions(live, late="100 days"), spark, "sessions", tmp_path)
    total = got.agg(F.sum("packets"), F.sum("bytes")).first()
    assert tuple(total) == tuple(df.where("src_ip is not null").agg(F.count(F.lit(1)), F.sum(F.col("frame_len").cast("long"))).first())
    keys = lambda x: {tuple(r) for r in x.select("a_ip", "a_port", "b_ip", "b_port", "proto").distinct().collect()}
    ours = W.flows(df.where("src_ip is not null and proto in ('tcp', 'udp')"))
    assert keys(got.where("proto in ('tcp', 'udp')")) == keys(ours)


def test_exports(spark, tmp_path):
    df = packets(spark, SF)
    for name, rows, width in (("packets", exports.packet_rows(df), 12), ("flows", exports.flow_rows(W.flows(df)), 17)):
        assert len(rows.columns) == width
        exports.write_csv(rows, str(tmp_path / name))
        again = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / name))
        assert again.columns == rows.columns and again.count() == rows.count()
    odd = spark.createDataFrame([('a"b,c\nd\te',)], "x string").select(exports.clean(F.col("x")).alias("x"))
    exports.write_csv(odd, str(tmp_path / "odd"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "odd")).first().x == 'a"b,cd\te'
