"""Traffic statistics: one aggregate for the totals, one for each keyed table.

All inputs are logical packets (see :mod:`tidewire.plans.bridge` for the columns).  Every
grouping aggregates within partitions first, so a key that holds a third of the rows costs
a shuffle of one row per task; top lists end in a distributed top-k with a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import packet as P
from tidewire.functions.lookups import service_name

#: Size classes of a frame and their labels.
SIZE_CLASSES = ((0, "0-63"), (64, "64-127"), (128, "128-255"), (256, "256-511"), (512, "512-1023"), (1024, "1024-1519"), (1520, "1520+"))
GENERIC = ("TCP", "UDP", "IPv4", "IPv6")


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _given(packets: DataFrame, flag: str) -> Column:
    """A flag that decoded packets have and others may lack."""
    return F.col(flag) if flag in packets.columns else F.lit(False)


def _bad_checksums() -> Column:
    """IPv4 header and transport checksum each count."""
    return F.coalesce((~F.col("ip_checksum_ok")).cast("int"), F.lit(0)) + F.coalesce((~F.col("l4_checksum_ok")).cast("int"), F.lit(0))


def totals(packets: DataFrame) -> DataFrame:
    """One row with every counter, sizes, first and last time, and rates."""
    size = F.col("frame_len").cast("long")
    counted = packets.agg(
        F.count(F.lit(1)).alias("packets"),
        F.coalesce(F.sum(size), F.lit(0)).alias("bytes"),
        F.min(F.when(size > 0, size)).alias("min_size"),
        F.max(size).alias("max_size"),
        _count(F.col("kind") == "arp").alias("arp"),
        _count(F.col("ip_version") == 4).alias("ipv4"),
        _count(F.col("ip_version") == 6).alias("ipv6"),
        _count(F.col("proto") == "tcp").alias("tcp"),
        _count(F.col("proto") == "udp").alias("udp"),
        _count(F.col("proto") == "icmp").alias("icmp"),
        (_count(F.col("dst_mac") == "ff:ff:ff:ff:ff:ff") + _count(F.col("dst_ip_key") == "04ffffffff")).alias("broadcast"),
        _count(F.col("dst_ip_key").between("04e0", "04f") | F.col("dst_ip_key").startswith("06ff")).alias("multicast"),
        _count((F.col("kind") != "arp") & (F.col("ip_version") == 0)).alias("other"),
        F.coalesce(F.sum(F.when((F.col("kind") != "arp") & (F.col("ip_version") != 0), size)), F.lit(0)).alias("ip_bytes"),
        _count(_given(packets, "fragment")).alias("fragments"),
        _count(_given(packets, "malformed")).alias("malformed"),
        F.coalesce(F.sum(_bad_checksums()), F.lit(0)).alias("bad_checksums"),
        _count(P.is_syn()).alias("syn"),
        _count(P.is_syn_ack()).alias("syn_ack"),
        _count(P.is_fin()).alias("fin"),
        _count(P.is_rst()).alias("rst"),
        _count(F.col("protocol") == "DNS").alias("dns"),
        _count(F.col("protocol") == "HTTP").alias("http"),
        _count(F.col("protocol").startswith("TLS")).alias("tls"),
        _count(F.col("protocol") == "DHCP").alias("dhcp"),
        _count(F.col("protocol") == "NTP").alias("ntp"),
        _count(F.col("truncated")).alias("truncated"),
        F.coalesce(F.sum(F.col("payload_len").cast("long")), F.lit(0)).alias("payload_bytes"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
    )
    return counted.select("*", *rates())


def rates() -> list[Column]:
    """Duration and rates of counted packets and bytes; without a duration the packets themselves are the rate."""
    seconds = F.greatest(F.lit(0), F.col("last_us") - F.col("first_us")) / F.lit(1e6)
    per = lambda x: F.when(seconds > 0, F.col(x) / seconds).otherwise(F.col(x).cast("double"))
    return [
        F.round(seconds, 6).alias("duration_s"),
        F.round(per("packets"), 6).alias("packets_per_s"),
        F.round(per("bytes"), 6).alias("bytes_per_s"),
        F.round(F.when(F.col("packets") > 0, F.col("bytes") / F.col("packets")), 6).alias("mean_size"),
    ]


def protocol_breakdown(packets: DataFrame) -> DataFrame:
    """protocol, packets, bytes and their shares; an empty protocol is ``unknown``."""
    name = F.when(F.coalesce(F.col("protocol"), F.lit("")) == "", "unknown").otherwise(F.col("protocol"))
    counted = packets.groupBy(name.alias("protocol")).agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("frame_len").cast("long")).alias("bytes"))
    everything = Window.partitionBy()  # over one row per protocol
    share = lambda x: F.round(F.lit(100.0) * F.col(x) / F.sum(x).over(everything), 6)
    return counted.select("protocol", "packets", "bytes", share("packets").alias("packet_share"), share("bytes").alias("byte_share"))


def endpoints(packets: DataFrame) -> DataFrame:
    """Per address: packets and bytes sent and received, and its MAC (last as a source, else first as a destination)."""
    size = F.col("frame_len").cast("long")
    roles = F.array(
        F.struct(F.col("src_ip").alias("ip"), F.col("src_ip_key").alias("key"), F.lit(True).alias("sent"), F.col("src_mac").alias("mac")),
        F.struct(F.col("dst_ip").alias("ip"), F.col("dst_ip_key").alias("key"), F.lit(False).alias("sent"), F.col("dst_mac").alias("mac")),
    )
    sides = packets.where(F.col("src_ip").isNotNull() | F.col("dst_ip").isNotNull()).select("number", size.alias("size"), F.inline(roles)).where("ip is not null")
    sent, got = F.col("sent"), ~F.col("sent")
    return sides.groupBy("ip").agg(
        F.count_if(sent).alias("tx_packets"),
        F.coalesce(F.sum(F.when(sent, F.col("size"))), F.lit(0)).alias("tx_bytes"),
        F.count_if(got).alias("rx_packets"),
        F.coalesce(F.sum(F.when(got, F.col("size"))), F.lit(0)).alias("rx_bytes"),
        F.coalesce(F.max_by("mac", F.when(sent, F.col("number"))), F.min_by("mac", F.when(got, F.col("number")))).alias("mac"),
    )


def top_talkers(packets: DataFrame, n: int = 10) -> DataFrame:
    total = F.col("tx_bytes") + F.col("rx_bytes")
    return endpoints(packets).orderBy(total.desc(), (F.col("tx_packets") + F.col("rx_packets")).desc(), "ip").limit(n)


def conversations(packets: DataFrame) -> DataFrame:
    """Both directions of a five-tuple as one row; ARP has no addresses here and takes no part.

    ``application`` is the first protocol, or the longest of those that are longer and not
    generic, the earliest of equals: a plain aggregate instead of a fold over the packets.
    """
    size = F.col("frame_len").cast("long")
    sided = packets.where("src_ip is not null and dst_ip is not null").withColumns(P.conversation_columns())
    grouped = sided.groupBy("a_ip", "a_port", "b_ip", "b_port", "proto").agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum(size).alias("bytes"),
        F.coalesce(F.sum(F.when(F.col("from_a"), size)), F.lit(0)).alias("a_to_b_bytes"),
        F.coalesce(F.sum(F.when(~F.col("from_a"), size)), F.lit(0)).alias("b_to_a_bytes"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.min_by("protocol", "number").alias("first_protocol"),
        F.max_by("protocol", F.when(~F.col("protocol").isin(*GENERIC), F.struct(F.length("protocol"), -F.col("number")))).alias("special"),
    )
    longer = F.length("special") > F.length("first_protocol")
    application = F.when(longer, F.col("special")).otherwise(F.col("first_protocol"))
    return grouped.withColumn("application", application).drop("first_protocol", "special")


def top_conversations(packets: DataFrame, n: int = 10) -> DataFrame:
    return conversations(packets).orderBy(F.desc("bytes"), F.desc("packets"), "a_ip", "a_port", "b_ip", "b_port", "proto").limit(n)


def ports(packets: DataFrame, proto: str) -> DataFrame:
    """port, packets, bytes and service of the serving side, port 0 left out."""
    served = packets.where(F.col("proto") == proto).select(P.service_port().alias("port"), "proto", F.col("frame_len").cast("long").alias("size")).where("port > 0")
    return service_name(served.groupBy("port", "proto").agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"))).drop("proto")


def top_ports(packets: DataFrame, proto: str, n: int = 10) -> DataFrame:
    return ports(packets, proto).orderBy(F.desc("packets"), F.desc("bytes"), "port").limit(n)


def size_histogram(packets: DataFrame) -> DataFrame:
    """Seven size classes, each with its count, also where that is zero."""
    size = F.col("frame_len")
    at = F.lit(0)
    for k, (low, _) in enumerate(SIZE_CLASSES):
        at = F.when(size >= low, k).otherwise(at)
    counted = packets.where(size.isNotNull()).groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    labels = packets.sparkSession.createDataFrame([(k, label) for k, (_, label) in enumerate(SIZE_CLASSES)], "bucket int, label string")
    return labels.join(counted, "bucket", "left").select("bucket", "label", F.coalesce("n", F.lit(0)).alias("packets"))


def time_series(packets: DataFrame, interval_ms: int = 1000) -> DataFrame:
    """Packets and bytes per interval, counted from the first 100 ms bucket; empty intervals are left out.

    The first bucket is an aggregate of the rows (a one-row broadcast), so the plan is one
    narrow pass and a grouping that shuffles a row per task and interval.
    """
    step = max(100, interval_ms)
    base = F.floor(F.col("ts_us") / 100_000).cast("long") * 100
    first = packets.agg(F.min(base).alias("first_ms"))
    placed = packets.select(base.alias("ms"), F.col("frame_len").cast("long").alias("size")).crossJoin(F.broadcast(first))
    start = F.col("first_ms") + F.floor((F.col("ms") - F.col("first_ms")) / step).cast("long") * step
    counted = placed.groupBy(start.alias("start_ms")).agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"))
    return counted.select("start_ms", "packets", "bytes", F.round(F.col("bytes") * 8 * 1000 / step, 6).alias("bits_per_s"))


#: Packet numbers that one task walks through of a flow's direction.
RANGE = 100_000
DIRECTION = ("src_ip", "src_port", "dst_ip", "dst_port")


def retransmissions(packets: DataFrame) -> DataFrame:
    """TCP packets with payload that end no further than an earlier one of their flow and direction."""
    narrow = packets.where("proto = 'tcp'").select("number", *DIRECTION, "seq", "payload_len")
    return retransmitted(narrow).select("number", *DIRECTION, "seq", "payload_len")


def retransmitted(tcp: DataFrame) -> DataFrame:
    """The retransmissions among TCP packets (number, direction, seq, payload_len and others).

    The furthest end so far is a running maximum.  It is taken within ranges of packet
    numbers, after a running maximum over one row per range, so the longest flow is walked
    by many tasks; only packets with payload are shuffled.
    """
    end = (F.col("seq") + F.col("payload_len")).bitwiseAND(F.lit(4294967295))
    ended = tcp.where("payload_len > 0").select("*", end.alias("_end"), F.floor(F.col("number") / RANGE).cast("long").alias("_range"))
    key = [*DIRECTION, "_range"]
    earlier = Window.partitionBy(*DIRECTION).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ended.groupBy(*key).agg(F.max("_end").alias("_top")).withColumn("_before", F.max("_top").over(earlier)).drop("_top")
    within = Window.partitionBy(*key).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    walked = ended.withColumn("_within", F.max("_end").over(within)).join(ranges, key)
    return walked.where(F.col("_end") <= F.greatest("_within", "_before")).drop("_end", "_range", "_within", "_before")


def run_summary(packets: DataFrame, matched: Column) -> DataFrame:
    """How many packets and bytes a filter lets through; decode errors are NULL where packets do not say whether they broke off."""
    decode_errors = F.count_if(F.coalesce(F.col("malformed"), F.lit(False))) if "malformed" in packets.columns else F.lit(None).cast("long")
    hit, size = F.coalesce(matched, F.lit(False)), F.col("frame_len").cast("long")
    return packets.agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if(hit).alias("matched"),
        F.count_if(~hit).alias("filtered_out"),
        F.coalesce(F.sum(size), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.when(hit, size)), F.lit(0)).alias("matched_bytes"),
        F.count_if(F.col("truncated")).alias("truncated"),
        decode_errors.alias("decode_errors"),
    )


def undecoded(frames: DataFrame) -> DataFrame:
    """Raw frames as packets of which only number, time and size are known, under the protocol ``undecoded``.

    Joined to packets by :func:`merge`, they count in sizes, times and as other packets.
    """
    size = F.octet_length("frame").alias("frame_len")
    return frames.select("number", "ts_us", F.lit("other").alias("kind"), F.lit("other").alias("proto"), F.lit("undecoded").alias("protocol"), F.lit(0).alias("ip_version"), size, (F.col("orig_len") > F.col("cap_len")).alias("truncated"))


def merge(*captures: DataFrame) -> DataFrame:
    """Several captures as one, each packet with its capture's number; statistics are then computed anew, losing nothing."""
    numbered = [c.withColumn("capture", F.lit(k)) for k, c in enumerate(captures)]
    out = numbered[0]
    for c in numbered[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out
