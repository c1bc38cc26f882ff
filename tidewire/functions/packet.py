"""Columns over logical packets: flags, ports, directions and flow keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.lookups import TCP_FLAGS

FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16


def flag(bit: int, flags: Column | str = "tcp_flags") -> Column:
    flags = F.col(flags) if isinstance(flags, str) else flags
    return flags.bitwiseAND(F.lit(bit)) != 0


def is_tcp() -> Column:
    return F.col("proto") == "tcp"


def is_syn() -> Column:
    return is_tcp() & flag(SYN) & ~flag(ACK)


def is_syn_ack() -> Column:
    return is_tcp() & flag(SYN) & flag(ACK)


def is_plain_ack() -> Column:
    return is_tcp() & flag(ACK) & ~flag(SYN) & ~flag(FIN)


def is_fin() -> Column:
    return is_tcp() & flag(FIN)


def is_rst() -> Column:
    return is_tcp() & flag(RST)


def flags_text(flags: Column | str = "tcp_flags") -> Column:
    """Set flags in wire order, comma-joined; ``none`` if there are none."""
    named = F.array(*[F.when(flag(1 << i, flags), F.lit(name)) for i, name in enumerate(TCP_FLAGS)])
    text = F.array_join(F.array_compact(named), ",")
    return F.when(text == "", "none").otherwise(text)


def service_port(src: Column | str = "src_port", dst: Column | str = "dst_port") -> Column:
    """The side of a packet that serves: a port below 1024 facing one that is not, else the smaller."""
    src, dst = (F.col(c) if isinstance(c, str) else c for c in (src, dst))
    return F.when((dst < 1024) & (src >= 1024), dst).when((src < 1024) & (dst >= 1024), src).otherwise(F.least(src, dst))


def interesting_port(src: Column | str = "src_port", dst: Column | str = "dst_port") -> Column:
    """As :func:`service_port`, but a port of zero gives way to the other."""
    src, dst = (F.col(c) if isinstance(c, str) else c for c in (src, dst))
    return F.when(src == 0, dst).when(dst == 0, src).otherwise(service_port(src, dst))


def conversation_columns() -> dict[str, Column]:
    """Sides a and b of a packet: the smaller address is a; equal addresses are never swapped."""
    swap = F.col("dst_ip_key") < F.col("src_ip_key")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return {
        "a_ip": pick("src_ip", "dst_ip"),
        "a_key": pick("src_ip_key", "dst_ip_key"),
        "a_port": pick("src_port", "dst_port"),
        "b_ip": pick("dst_ip", "src_ip"),
        "b_key": pick("dst_ip_key", "src_ip_key"),
        "b_port": pick("dst_port", "src_port"),
        "from_a": ~swap,
    }


def source_text(ip: str = "src_ip", port: str = "src_port", mac: str = "src_mac") -> Column:
    """address:port, the address alone without a port, the MAC without an address, or ``-``."""
    address = F.when(F.col(port) > 0, F.concat(F.col(ip), F.lit(":"), F.col(port).cast("string"))).otherwise(F.col(ip))
    return F.coalesce(address, F.col(mac), F.lit("-"))


def flow_key_text() -> Column:
    """One text for both directions of a flow; ties on equal addresses are broken by the port."""
    left = F.struct(F.col("src_ip_key").alias("k"), F.col("src_port").alias("p"), F.col("src_ip").alias("t"))
    right = F.struct(F.col("dst_ip_key").alias("k"), F.col("dst_port").alias("p"), F.col("dst_ip").alias("t"))
    low, high = F.least(left, right), F.greatest(left, right)
    return F.concat_ws("|", F.col("proto"), F.concat(low["t"], F.lit(":"), low["p"].cast("string")), F.concat(high["t"], F.lit(":"), high["p"].cast("string")))
