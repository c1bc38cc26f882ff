"""Packets, flows and scan results as flat rows for CSV and JSON files.

The rows are DataFrames and Spark writes them, a file per task; nothing passes the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import packet as P

#: Control characters that a field loses; tabs stay.
_CONTROLS = r"[\x00-\x08\x0a-\x1f]"


def clean(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _CONTROLS, "")


def _time(us: str) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def packet_rows(packets: DataFrame, matched: Column | None = None) -> DataFrame:
    """Twelve columns per packet; ``matched`` tells which ones a filter lets through."""
    transport = F.when(F.col("proto").isin("tcp", "udp", "icmp"), F.col("proto")).otherwise("")
    return packets.select(
        "number",
        _time("ts_us").alias("timestamp"),
        F.format_string("%d.%06d", F.expr("ts_us div 1000000"), F.col("ts_us") % 1_000_000).alias("time"),
        clean(F.coalesce("src_ip", "src_mac")).alias("source"),
        "src_port",
        clean(F.coalesce("dst_ip", "dst_mac")).alias("destination"),
        "dst_port",
        transport.alias("transport"),
        clean(F.col("protocol")).alias("protocol"),
        F.col("frame_len").alias("length"),
        (F.lit(True) if matched is None else F.coalesce(matched, F.lit(False))).alias("matched"),
        clean(F.when(F.col("proto") == "tcp", P.flags_text()).otherwise(F.coalesce("dns_qname", F.lit("")))).alias("info"),
    )


def flow_rows(flows: DataFrame) -> DataFrame:
    """Seventeen columns per flow."""
    detail = F.coalesce("dns_name", F.concat_ws("", "http_host", "http_uri"), "tls_sni", F.lit(""))
    return flows.select(
        F.upper("proto").alias("protocol"),
        clean(F.col("a_ip")).alias("source"),
        F.col("a_port").alias("src_port"),
        clean(F.col("b_ip")).alias("destination"),
        F.col("b_port").alias("dst_port"),
        "state",
        "packets",
        "bytes",
        F.col("bytes_forward").alias("a_to_b_bytes"),
        F.col("bytes_backward").alias("b_to_a_bytes"),
        "retransmissions",
        F.format_string("%.3f", F.col("duration_us") / 1e6).alias("duration_seconds"),
        _time("first_us").alias("first_seen"),
        _time("last_us").alias("last_seen"),
        F.lower("application").alias("service"),
        "application",
        clean(detail).alias("info"),
    )


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """With a header; quotes within a field are doubled."""
    rows.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)
