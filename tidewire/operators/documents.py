"""Decoded packets as JSON documents with a part for every layer that they have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.decode.info import hex_text, text
from tidewire.functions import names as N
from tidewire.functions import packet as P
from tidewire.functions.lookups import ARP_OPERATIONS, DNS_RCODES, DNS_TYPES, IP_PROTOCOLS, named
from tidewire.operators.layers import ether_type, utc_time, vendor_of

#: Bytes of a payload that a document holds.
PAYLOAD_BYTES = 256


def _endpoint(side: str) -> Column:
    """Address with its port under TCP and UDP, else the MAC; the target of an ARP message by its address."""
    arp = F.col("arp.sender_mac") if side == "src" else F.col("arp.target_ip.text")
    ported = F.col("tcp").isNotNull() | F.col("udp").isNotNull()
    address = F.col(f"{side}_ip.text")
    return F.coalesce(F.when(ported, text(address, ":", F.col(f"{side}_port"))).otherwise(address), arp, F.col(f"eth.{side}"), F.lit("-"))


def _flow_key() -> Column:
    """Protocol number and both ends, the smaller first; ARP and other frames by what they have."""
    end = lambda side: F.struct(F.col(f"{side}_ip.key").alias("k"), F.coalesce(F.col(f"{side}_port"), F.lit(0)).alias("p"), F.col(f"{side}_ip.text").alias("t"))
    low, high = F.least(end("src"), end("dst")), F.greatest(end("src"), end("dst"))
    both = F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()
    return (
        F.when(both, text(F.col("ip_protocol"), ":", low["t"], ":", low["p"], ":", high["t"], ":", high["p"]))
        .when(F.col("arp").isNotNull(), text("arp:", F.col("arp.sender_ip.text"), ":", F.col("arp.target_ip.text")))
        .when(F.col("eth").isNotNull(), text("eth:", F.col("eth.src"), ":", F.col("eth.dst")))
        .otherwise("unknown")
    )


def _part(name: str, **fields: Column) -> Column:
    """A layer's part under its name, NULL without the layer."""
    return F.when(F.col(name).isNotNull(), F.struct(*[v.alias(k) for k, v in fields.items()]))


def _fields(name: str, *names: str) -> dict[str, Column]:
    return {n: F.col(f"{name}.{n}") for n in names}


def _checked(name: str) -> dict[str, Column]:
    return {"checksum": hex_text(F.col(f"{name}.checksum"), 4), "checksum_valid": F.col(f"{name}.checksum_valid"), "checksum_zero": F.col(f"{name}.checksum") == 0}


def _options(name: str, kind: str, value: bool) -> Column:
    """Options that there are, NULL if there are none."""

    def one(o: Column) -> Column:
        told = [F.nullif(o["value"], F.lit("")).alias("value")] if value else []
        return F.struct(o["kind"].alias(kind), o["name"].alias("name"), *told)

    return F.when(F.size(f"{name}.options") > 0, F.transform(f"{name}.options", one))


def _dns() -> dict[str, Column]:
    flag = lambda mask: F.col("dns.flags").bitwiseAND(F.lit(mask)) != 0
    records = lambda section: F.transform(f"dns.{section}", lambda r: F.struct(r["name"].alias("name"), named(r["type"], DNS_TYPES, "TYPE%d").alias("type"), r["ttl"].alias("ttl"), r["data"].alias("data")))
    return {
        "id": F.col("dns.id"),
        "query": F.col("dns.is_query"),
        **_fields("dns", "opcode", "rcode"),
        "rcode_name": named(F.col("dns.rcode"), DNS_RCODES, "rcode %d"),
        "authoritative": flag(0x400),
        "truncated": flag(0x200),
        "recursion_desired": flag(0x100),
        "recursion_available": flag(0x80),
        "valid": F.col("dns.valid"),
        "summary": F.col("summary"),
        "questions": F.transform("dns.questions", lambda q: F.struct(q["name"].alias("name"), q["type_name"].alias("type"))),
        **{s: records(s) for s in ("answers", "authority", "additional")},
    }


def _http() -> dict[str, Column]:
    asks = F.col("http.request")
    return {
        "request": asks,
        "method": F.when(asks, F.col("http.method")),
        "uri": F.when(asks, F.col("http.uri")),
        "status_code": F.when(~asks, F.col("http.status_code")),
        "status_text": F.when(~asks, F.col("http.reason")),
        **_fields("http", "version", "host", "user_agent", "content_type", "server", "content_length", "headers"),
        "body_length": F.col("http.body_size"),
    }


def _layers() -> dict[str, Column]:
    echo = F.col("icmp.type").isin(0, 8, 128, 129)
    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    return {
        "ethernet": _part("eth", src=F.col("eth.src"), src_vendor=vendor_of(F.col("eth.src")), dst=F.col("eth.dst"), dst_vendor=vendor_of(F.col("eth.dst")), type=ether_type(F.col("eth.ether_type"))),
        "vlans": F.when(F.size("vlans") > 0, F.transform("vlans", lambda v: F.struct(v["id"].alias("id"), v["priority"].alias("priority")))),
        "arp": _part(
            "arp", **_fields("arp", "opcode"), operation=named(F.col("arp.opcode"), ARP_OPERATIONS, "opcode %d"), **_fields("arp", "sender_mac"), sender_ip=F.col("arp.sender_ip.text"),
            **_fields("arp", "target_mac"), target_ip=F.col("arp.target_ip.text"),
        ),
        "ip": _part(
            "ipv4", version=F.lit(4), src=F.col("ipv4.src.text"), dst=F.col("ipv4.dst.text"), ttl=F.col("ipv4.ttl"), protocol=named(F.col("ipv4.protocol"), IP_PROTOCOLS, "protocol %d"), protocol_number=F.col("ipv4.protocol"),
            **_fields("ipv4", "total_length", "identification"), flags_df=F.col("ipv4.df"), flags_mf=F.col("ipv4.mf"), **_fields("ipv4", "fragment_offset"), dscp=F.shiftright("ipv4.tos", 2),
            ecn=F.col("ipv4.tos").bitwiseAND(F.lit(3)), checksum=hex_text(F.col("ipv4.checksum"), 4), checksum_valid=F.col("ipv4.checksum_valid"), options=_options("ipv4", "type", False),
        ),
        "ipv6": _part("ipv6", version=F.lit(6), src=F.col("ipv6.src.text"), dst=F.col("ipv6.dst.text"), **_fields("ipv6", "hop_limit", "traffic_class", "flow_label", "payload_length"), next_header=named(F.col("ipv6.next_header"), IP_PROTOCOLS, "protocol %d")),
        "tcp": _part("tcp", **_fields("tcp", "src_port", "dst_port", "seq", "ack"), flags=P.flags_text(F.col("tcp.flags")), flags_raw=F.col("tcp.flags"), **_fields("tcp", "window"), **_checked("tcp"), options=_options("tcp", "kind", True)),
        "udp": _part("udp", **_fields("udp", "src_port", "dst_port", "length"), **_checked("udp")),
        "icmp": _part("icmp", **_fields("icmp", "type", "code", "description", "checksum_valid"), id=F.when(echo, F.col("icmp.id")), sequence=F.when(echo, F.col("icmp.sequence")), payload_length=size),
        "dns": _part("dns", **_dns()),
        "http": _part("http", **_http()),
        "tls": _part(
            "tls", summary=F.col("summary"), **_fields("tls", "sni", "version"), records=F.transform("tls.records", lambda r: F.struct(r["content_type"].alias("content_type"), r["length"].alias("length"))),
            cipher_suites=F.when(F.size("tls.cipher_suites") > 0, F.col("tls.cipher_suites")),
        ),
    }


def documents(packets: DataFrame, payload: bool = False) -> DataFrame:
    """number and ``json`` of each decoded packet; parts without a value are left out.

    With ``payload`` its length, the first :data:`PAYLOAD_BYTES` bytes as hex digits and as
    text; else its length alone.  Times are UTC.
    """
    c = F.col
    ports = c("tcp").isNotNull() | c("udp").isNotNull()
    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    shown = F.substring(c("payload"), 1, PAYLOAD_BYTES)
    body = F.struct(size.alias("length"), F.lower(F.hex(shown)).alias("hex"), F.regexp_replace(F.decode(shown, "ISO-8859-1"), r"[^\x20-\x7e]", ".").alias("ascii"))
    fields = {
        "number": c("number"),
        "time": utc_time(),
        "epoch": c("ts_us") / F.lit(1e6),
        "length": F.octet_length("frame"),
        "captured_length": c("cap_len"),
        "original_length": c("orig_len"),
        "truncated": c("truncated"),
        "malformed": c("malformed"),
        "malformed_reason": F.when(c("malformed"), c("reason")),
        "interface": c("interface"),
        "linktype": N.link_name(c("link_type")),
        "protocol": c("protocol"),
        "protocols": F.array_join("layers", ":"),
        "info": c("info"),
        "src": _endpoint("src"),
        "dst": _endpoint("dst"),
        "src_ip": c("src_ip.text"),
        "dst_ip": c("dst_ip.text"),
        "src_port": F.when(ports, c("src_port")),
        "dst_port": F.when(ports, c("dst_port")),
        "flow_key": _flow_key(),
        **_layers(),
        "payload": F.when((size > 0) & F.lit(payload), body),
        "payload_length": F.when((size == 0) | F.lit(not payload), size),
    }
    return packets.select("number", F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()])).alias("json"))
