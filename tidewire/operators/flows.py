"""Bidirectional flows with TCP state, as one grouping.

A fold over the packets of a flow is rewritten as order-free aggregates: ``max_by`` and
``min_by`` on the packet number for last and first values, counts of flags for the state.
They aggregate within partitions, so a hot flow is no hot task.  Only retransmissions need
packets in order: they are found in a branch of narrow rows, TCP packets with payload alone,
and their counts are joined to the flows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import packet as P
from tidewire.operators.stats import DIRECTION, retransmitted

KEY = ("a_ip", "a_port", "b_ip", "b_port", "proto")
#: Seconds without a packet after which a flow is over.
IDLE_TCP, IDLE_OTHER = 300, 120
#: Names that a flow's state goes by.
STATE_NAMES = {"new": "new", "syn-sent": "syn-sent", "synsent": "syn-sent", "syn-received": "syn-received", "synreceived": "syn-received", "established": "established", "est": "established", "fin-wait": "fin-wait", "finwait": "fin-wait", "closed": "closed", "close": "closed", "reset": "reset", "rst": "reset", "unknown": "unknown"}
STRONG = ("HTTP", "DNS", "DHCP", "NTP")


def parse_state(text: str) -> str | None:
    return STATE_NAMES.get(text.strip().lower())


def keyed(packets: DataFrame) -> DataFrame:
    """Flow key and direction of each packet; ARP by its own addresses, packets without any are left out."""
    ip = lambda side, other: F.coalesce(F.col(side), F.col(other))
    addressed = packets.withColumns(
        {
            "src_ip": ip("src_ip", "arp_sender_ip"),
            "dst_ip": ip("dst_ip", "arp_target_ip"),
            "src_ip_key": ip("src_ip_key", "arp_sender_key"),
            "dst_ip_key": ip("dst_ip_key", "arp_target_key"),
            "src_port": F.when(F.col("proto").isin("tcp", "udp"), F.col("src_port")).otherwise(0),
            "dst_port": F.when(F.col("proto").isin("tcp", "udp"), F.col("dst_port")).otherwise(0),
        }
    )
    sides = P.conversation_columns()
    forward = sides.pop("from_a")
    return addressed.where("src_ip is not null or dst_ip is not null").withColumns(sides | {"forward": forward})


def _last(value: Column, given: Column | None = None) -> Column:
    """The value of the last packet that has one."""
    present = value.isNotNull() if given is None else given
    return F.max_by(value, F.when(present, F.col("number")))


def state_of() -> Column:
    """The state of a flow from its ``_`` columns: what closed it last, else how far its handshake came."""
    closed = F.col("_fins_forward") & F.col("_fins_backward")
    tcp = (
        F.when(F.col("_last_is_reset"), "reset")
        .when(F.col("_last_is_reset").isNotNull(), F.when(closed, "closed").otherwise("fin-wait"))
        .when(F.col("_acked"), "established")
        .when(F.col("_syn_acked"), "syn-received")
        .when(F.col("_syn"), "syn-sent")
        .otherwise("new")
    )
    return F.when(F.col("proto") == "tcp", tcp).when(F.col("proto") == "udp", "established").otherwise("unknown")


def flows(packets: DataFrame, *more: Column) -> DataFrame:
    """One row per flow: packets, bytes and payload by direction, times, state, retransmissions, last attributes.

    ``more`` are further aggregates over the packets with their flow key, taken in the same grouping.
    """
    sided = keyed(packets)
    size = F.col("frame_len").cast("long")
    tcp = F.col("proto") == "tcp"
    reset, fin = tcp & P.flag(P.RST), tcp & P.flag(P.FIN) & ~P.flag(P.RST) & ~P.flag(P.SYN)
    forward, backward = F.col("forward"), ~F.col("forward")
    total = lambda condition, value: F.coalesce(F.sum(F.when(condition, value)), F.lit(0))
    any_of = lambda condition: F.coalesce(F.bool_or(condition), F.lit(False))
    strong = F.col("protocol").isin(*STRONG) | F.col("protocol").startswith("TLS")
    again = retransmitted(sided.where(tcp).select("number", *DIRECTION, *KEY, "seq", "payload_len")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("retransmissions"))
    grouped = sided.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum(size).alias("bytes"),
        F.count_if(forward).alias("packets_forward"),
        F.count_if(backward).alias("packets_backward"),
        total(forward, size).alias("bytes_forward"),
        total(backward, size).alias("bytes_backward"),
        F.sum(F.col("payload_len").cast("long")).alias("payload_bytes"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.max_by(reset, F.when(reset | fin, F.col("number"))).alias("_last_is_reset"),
        any_of(fin & forward).alias("_fins_forward"),
        any_of(fin & backward).alias("_fins_backward"),
        any_of(tcp & P.flag(P.ACK) & ~P.flag(P.SYN)).alias("_acked"),
        any_of(tcp & P.flag(P.ACK) & P.flag(P.SYN)).alias("_syn_acked"),
        any_of(tcp & P.flag(P.SYN)).alias("_syn"),
        F.coalesce(_last(F.col("protocol"), strong), F.min_by("protocol", "number")).alias("application"),
        _last(F.col("ttl"), F.col("ttl") > 0).alias("last_ttl"),
        _last(F.col("tcp_window"), tcp).alias("last_window"),
        _last(F.col("src_mac"), forward).alias("a_mac"),
        _last(F.col("src_mac"), backward).alias("b_mac"),
        _last(F.col("dns_qname")).alias("dns_name"),
        _last(F.col("http_host"), F.col("http_host") != "").alias("http_host"),
        _last(F.col("http_uri"), F.col("http_uri") != "").alias("http_uri"),
        _last(F.col("http_status"), F.col("http_status") > 0).alias("http_status"),
        _last(F.col("tls_sni"), F.col("tls_sni") != "").alias("tls_sni"),
        *more,
    )
    # flows with retransmissions have both addresses; the others have none
    counted = grouped.join(again, list(KEY), "left").withColumn("retransmissions", F.coalesce("retransmissions", F.lit(0)))
    out = counted.withColumn("state", state_of()).withColumn("duration_us", F.greatest(F.lit(0), F.col("last_us") - F.col("first_us")))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


ORDERS = {
    "last": lambda: [F.desc("last_us")],
    "first": lambda: [F.asc("first_us")],
    "bytes": lambda: [F.desc("bytes")],
    "packets": lambda: [F.desc("packets")],
    "duration": lambda: [F.desc("duration_us")],
    "address": lambda: [],
}


def listed(found: DataFrame, sort: str = "last", limit: int | None = None) -> DataFrame:
    """Flows in one of the named orders; the key breaks ties."""
    out = found.orderBy(*ORDERS[sort](), *KEY)
    return out if limit is None else out.limit(limit)


def is_active() -> Column:
    return ~F.col("state").isin("closed", "reset")


def active(found: DataFrame, limit: int | None = None) -> DataFrame:
    return listed(found.where(is_active()), "last", limit)


def for_address(found: DataFrame, address: str, limit: int | None = None) -> DataFrame:
    return listed(found.where((F.col("a_ip") == address) | (F.col("b_ip") == address)), "bytes", limit)


def for_port(found: DataFrame, port: int, limit: int | None = None) -> DataFrame:
    return listed(found.where((F.col("a_port") == port) | (F.col("b_port") == port)), "bytes", limit)


def for_application(found: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    return listed(found.where(F.lower("application") == name.lower()), "bytes", limit)


def select(found: DataFrame, sort: str = "last", limit: int | None = None, address: str | None = None, port: int | None = None, only_active: bool = False) -> DataFrame:
    """The most particular choice given wins: address, port, active, then the order."""
    if address is not None:
        return for_address(found, address, limit)
    if port is not None:
        return for_port(found, port, limit)
    return active(found, limit) if only_active else listed(found, sort, limit)


def unexpired(found: DataFrame, packets: DataFrame) -> DataFrame:
    """Flows that were not idle for too long before the last packet of all (one row, broadcast)."""
    last = packets.agg(F.max("ts_us").alias("_end"))
    idle = F.when(F.col("proto") == "tcp", IDLE_TCP).otherwise(IDLE_OTHER) * 1_000_000
    return found.crossJoin(F.broadcast(last)).where(F.col("_end") - F.col("last_us") <= idle).drop("_end")


def summary(found: DataFrame) -> DataFrame:
    """One row of counts over flows."""
    return found.agg(
        F.count(F.lit(1)).alias("flows"),
        F.count_if(F.col("proto") == "tcp").alias("tcp"),
        F.count_if(F.col("proto") == "udp").alias("udp"),
        F.count_if(~F.col("proto").isin("tcp", "udp")).alias("other"),
        F.count_if(F.col("state") == "established").alias("established"),
        F.count_if(F.col("state").isin("closed", "reset")).alias("closed"),
        F.count_if(is_active()).alias("active"),
        F.coalesce(F.sum("packets"), F.lit(0)).alias("packets"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("retransmissions"), F.lit(0)).alias("retransmissions"),
        F.coalesce(F.max("duration_us"), F.lit(0)).alias("longest_us"),
    )
