"""Flows of a stream are those of the batch, wherever the stream is cut."""

import pytest
from pyspark.sql import functions as F

from tidewire.operators import flows as W
from tidewire.plans.bridge import packets
from tidewire.streaming import flow_state, traffic

SF = "/root/testdata/sf0.001"
FAR = 4000 * 86_400


def ended(spark, df, cuts, tmp_path, name, **more):
    """Rows that end when the packets come in files of so many parts; one far later packet moves the watermark."""
    flow_state.use_rocksdb(spark)
    folder = str(tmp_path / name)
    top = df.agg(F.max("number")).first()[0]
    for k in range(cuts):
        part = df.where((F.col("number") > top * k // cuts) & (F.col("number") <= top * (k + 1) // cuts))
        part.coalesce(1).write.mode("append").parquet(folder)
    late = df.where("proto = 'tcp'").limit(1).withColumns({"ts_us": F.col("ts_us") + F.lit(2 * FAR * 1_000_000), "number": F.lit(top + 1), "src_ip": F.lit("9.9.9.9"), "src_ip_key": F.lit("0409090909")})
    late.select(df.columns).coalesce(1).write.mode("append").parquet(folder)
    live = flow_state.live_flows(traffic.stream(spark, folder, df.schema, 1), late="1000 days", **more)
    query = live.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / (name + "_c"))).start()
    assert query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name)


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("cuts", [1, 3])
def test_as_batch(spark, tmp_path, cuts):
    df = packets(spark, SF).where("number <= 400")
    got = ended(spark, df, cuts, tmp_path, f"flows{cuts}", idle_tcp=FAR, idle_other=FAR)
    wanted = W.flows(df)
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got, wanted.columns) == rows(wanted, wanted.columns)


def reference(df, idle_tcp, idle_other):
    """Brute force: packets one by one in order."""
    open_, out = {}, []
    for r in sorted(W.keyed(df).collect(), key=lambda r: r.number):
        key = tuple(r[c] for c in W.KEY)
        idle = (idle_tcp if r.proto == "tcp" else idle_other) * 1_000_000
        f = open_.get(key)
        if f and r.ts_us - f["last"] > idle:
            out.append((*key, f["n"], f["again"], f["first"], f["last"]))
            f = None
        f = open_.setdefault(key, f) if f else open_.__setitem__(key, {"n": 0, "again": 0, "first": r.ts_us, "last": r.ts_us, "end": {}}) or open_[key]
        f["n"] += 1
        f["first"], f["last"] = min(f["first"], r.ts_us), max(f["last"], r.ts_us)
        if r.proto == "tcp" and r.payload_len > 0:
            end = (r.seq + r.payload_len) % 2**32
            reached = f["end"].get(r.forward)
            f["again"] += reached is not None and end <= reached
            f["end"][r.forward] = end if reached is None else max(end, reached)
    return sorted(out + [(*k, f["n"], f["again"], f["first"], f["last"]) for k, f in open_.items()], key=repr)


def test_idle_flows_end(spark, tmp_path):
    """Few endpoints, repeated segments, gaps of all sizes: a flow is cut at every gap above its idle time."""
    df = packets(spark, SF).where("number <= 300 and src_ip is not null").withColumns(
        {
            "src_ip": F.lit("10.0.0.1"), "src_ip_key": F.lit("040a000001"), "dst_ip": F.lit("10.0.0.2"), "dst_ip_key": F.lit("040a000002"),
            "src_port": (F.lit(1000) + F.col("number") % 3).cast("int"), "dst_port": F.lit(80),
            "seq": (F.col("number") * 7 % 40).cast("long"),
            "ts_us": F.col("number") * 1_000_000 + F.floor(F.col("number") / 25) * 100_000_000 + F.floor(F.col("number") / 50) * 150_000_000,
        }
    )
    df = df.select(*[F.col(f.name).cast(f.dataType) for f in packets(spark, SF).schema.fields])
    got = ended(spark, df, 4, tmp_path, "idle")
    found = rows(got, (*W.KEY, "packets", "retransmissions", "first_us", "last_us"))
    wanted = reference(df, W.IDLE_TCP, W.IDLE_OTHER)
    assert found == wanted
    assert len(wanted) > 20 and sum(r[6] for r in wanted) > 20
