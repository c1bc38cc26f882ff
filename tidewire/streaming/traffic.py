"""Traffic statistics and flows over a stream of logical packets.

State is bounded by the watermark: a window's counters go once it has passed, a flow's once
its idle gap has.  Both aggregate within a task before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions import packet as P
from tidewire.operators.flows import IDLE_OTHER, IDLE_TCP


def stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    """Packets from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def timed(packets: DataFrame, late: str = "10 seconds") -> DataFrame:
    """With an event time and a watermark on it."""
    return packets.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", late)


def per_window(packets: DataFrame, width: str = "1 second", slide: str | None = None, late: str = "10 seconds") -> DataFrame:
    """start_ms, protocol, packets, bytes of each window."""
    frame = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    counted = timed(packets, late).groupBy(frame.alias("w"), "protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("frame_len").cast("long")).alias("bytes"))
    return counted.select(F.unix_millis("w.start").alias("start_ms"), "protocol", "packets", "bytes")


def _state() -> Column:
    tcp = (
        F.when(F.col("reset"), "reset")
        .when(F.col("fin_forward") & F.col("fin_backward"), "closed")
        .when(F.col("fin_forward") | F.col("fin_backward"), "fin-wait")
        .when(F.col("acked"), "established")
        .when(F.col("syn_acked"), "syn-received")
        .when(F.col("syn"), "syn-sent")
        .otherwise("new")
    )
    return F.when(F.col("proto") == "tcp", tcp).when(F.col("proto") == "udp", "established").otherwise("unknown")


def flow_sessions(packets: DataFrame, late: str = "10 seconds") -> DataFrame:
    """One row per flow and idle gap, emitted once the gap has passed.

    A reset within a session counts as its end whatever follows, because packets of one
    micro-batch have no order across tasks.  Packets without addresses have no flow and do not
    move the watermark.
    """
    sides = P.conversation_columns()
    forward = sides.pop("from_a")
    gap = F.when(F.col("proto") == "tcp", f"{IDLE_TCP} seconds").otherwise(f"{IDLE_OTHER} seconds")
    sided = timed(packets, late).where("src_ip is not null").withColumns(sides | {"forward": forward})
    tcp, size = F.col("proto") == "tcp", F.col("frame_len").cast("long")
    any_of = lambda c: F.coalesce(F.bool_or(tcp & c), F.lit(False))
    found = sided.groupBy(F.session_window("event_time", gap).alias("w"), "a_ip", "a_port", "b_ip", "b_port", "proto").agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum(size).alias("bytes"),
        F.count_if("forward").alias("packets_forward"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        any_of(P.flag(P.RST)).alias("reset"),
        any_of(P.flag(P.FIN) & F.col("forward")).alias("fin_forward"),
        any_of(P.flag(P.FIN) & ~F.col("forward")).alias("fin_backward"),
        any_of(P.flag(P.ACK) & ~P.flag(P.SYN)).alias("acked"),
        any_of(P.flag(P.ACK) & P.flag(P.SYN)).alias("syn_acked"),
        any_of(P.flag(P.SYN)).alias("syn"),
    )
    return found.withColumn("state", _state()).drop("w", "reset", "fin_forward", "fin_backward", "acked", "syn_acked", "syn")
