"""Frames to nested header columns.

One Arrow function finds where the headers of a batch of frames lie and reads their numbers
(:mod:`tidewire.decode.layout`); addresses, names, HTTP and all texts are built-in
expressions over the frame and those numbers, so a query that wants the ports builds no
names.  DNS, TLS and DHCP bodies are walked by one more Arrow function each, on the candidate
rows alone.  Truncated headers give NULL fields, ``malformed`` and a ``reason``, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.decode import application as app
from tidewire.decode import info
from tidewire.decode.batch import small_batches
from tidewire.decode.binary import address, built_once, mac, part, small, uint
from tidewire.decode.layout import ARP, ETHERNET, IPV4, IPV6, KNOWN, REASONS, SLL, SLL2, layout
from tidewire.functions import names as N
from tidewire.functions.lookups import DNS_FLOW_TYPES, DNS_RCODES, ETHER_TYPES, IP_OPTIONS, TCP_OPTIONS, icmp_name, named

#: Ports by application.
DNS_PORTS = (53, 1053, 5353, 5354, 5355, 53000)
TLS_PORTS = (443, 465, 563, 636, 989, 990, 992, 993, 995, 2222, 4116, 5061, 5062, 8443, 8531, 9443, 27017)
HTTP_PORTS = (
    80, 81, 88, 591, 593, 832, 981, 1010, 1311, 2082, 2087, 2095, 2096, 2480, 3000, 3128, 3333, 4243, 4567, 4711, 4712, 5000, 5104, 5280, 5281, 5800, 5985, 6543, 7000, 7001, 7002, 7396, 7474,
    8000, 8001, 8008, 8014, 8042, 8069, 8080, 8081, 8088, 8090, 8091, 8118, 8123, 8172, 8222, 8243, 8280, 8281, 8333, 8443, 8500, 8800, 8888, 8983, 9000, 9001, 9002, 9043, 9060, 9080, 9090,
    9091, 9443, 9800, 9981, 11371, 12345, 15672, 18080, 55000, 55555,
)


def _h(name: str) -> Column:
    return F.col(f"_h.{name}")


def _frame_options(options: Column, kind: Column | str, value) -> Column:
    return F.transform(options, lambda o: F.struct(o["kind"].alias("kind"), kind(o).alias("name"), value(o).alias("value")))


def _tcp_option_value(o: Column) -> Column:
    data = F.col("frame")
    raw = part(data, o["at"], o["size"])
    stamps = F.concat(F.lit("TSval "), uint(data, o["at"], 4).cast("string"), F.lit(" TSecr "), uint(data, o["at"] + 4, 4).cast("string"))
    return (
        F.when(o["kind"] == 2, F.when(o["size"] >= 2, small(data, o["at"], 2).cast("string")).otherwise(""))
        .when(o["kind"] == 3, F.when(o["size"] >= 1, small(data, o["at"]).cast("string")).otherwise(""))
        .when(o["kind"] == 5, F.regexp_replace(F.lower(F.hex(raw)), "(..)(?=.)", "$1:"))
        .when(o["kind"] == 8, F.when(o["size"] >= 8, stamps).otherwise(""))
        .when(o["kind"].isin(*TCP_OPTIONS), "")
        .otherwise(F.lower(F.hex(raw)))
    )


@built_once
def _headers() -> dict[str, Column]:
    data, net, at = F.col("frame"), _h("net"), _h("l4")
    kind, six = F.col("link_type"), _h("proto") == 58
    bits = _h("fragment_bits")
    hw, pl = small(data, net + 4), small(data, net + 5)
    vlan = lambda k, o: small(data, 14 + 4 * k + o, 2)
    return {
        "ether_type": _h("ether_type"),
        "ip_protocol": _h("ip_protocol"),
        "eth": F.when((kind == ETHERNET) & (F.octet_length(data) >= 14), F.struct(mac(data, 6).alias("src"), mac(data, 0).alias("dst"), small(data, 12, 2).alias("ether_type"))),
        "sll": F.when((kind == SLL) & (F.octet_length(data) >= 16), F.struct(small(data, 0, 2).alias("packet_type"), small(data, 2, 2).alias("hardware_type"), small(data, 14, 2).alias("ether_type"))).when(
            (kind == SLL2) & (F.octet_length(data) >= 20), F.struct(small(data, 10).alias("packet_type"), small(data, 8, 2).alias("hardware_type"), small(data, 0, 2).alias("ether_type"))
        ),
        "vlans": F.transform(
            F.when(_h("tags") > 0, F.sequence(F.lit(0), _h("tags") - 1)).otherwise(F.array().cast("array<int>")),
            lambda k: F.struct(vlan(k, 0).bitwiseAND(F.lit(0xFFF)).alias("id"), F.shiftright(vlan(k, 0), 13).alias("priority"), (vlan(k, 0).bitwiseAND(F.lit(0x1000)) != 0).alias("dei"), vlan(k, 2).alias("inner_type")),
        ),
        "arp": F.when(
            _h("arp"),
            F.struct(
                small(data, net, 2).alias("hardware_type"),
                small(data, net + 2, 2).alias("protocol_type"),
                small(data, net + 6, 2).alias("opcode"),
                mac(data, net + 8).alias("sender_mac"),
                address(data, net + 8 + hw, 4).alias("sender_ip"),
                mac(data, net + 8 + hw + pl).alias("target_mac"),
                address(data, net + 8 + 2 * hw + pl, 4).alias("target_ip"),
            ),
        ),
        "ipv4": F.when(
            _h("ip") == 4,
            F.struct(
                _h("ihl").alias("header_length"),
                _h("tos").alias("tos"),
                _h("total_length").alias("total_length"),
                _h("identification").alias("identification"),
                (bits.bitwiseAND(F.lit(0x4000)) != 0).alias("df"),
                (bits.bitwiseAND(F.lit(0x2000)) != 0).alias("mf"),
                (bits.bitwiseAND(F.lit(0x1FFF)) * 8).alias("fragment_offset"),
                _h("ttl").alias("ttl"),
                _h("ip_protocol").alias("protocol"),
                _h("ip_checksum").alias("checksum"),
                _h("ip_checksum_valid").alias("checksum_valid"),
                address(data, net + 12, 4).alias("src"),
                address(data, net + 16, 4).alias("dst"),
                _frame_options(_h("ip_options"), lambda o: named(o["kind"], IP_OPTIONS, "option %d"), lambda o: F.lower(F.hex(part(data, o["at"], o["size"])))).alias("options"),
            ),
        ),
        "ipv6": F.when(
            _h("ip") == 6,
            F.struct(
                F.shiftright(_h("flow_word"), 20).alias("traffic_class"),
                _h("flow_word").bitwiseAND(F.lit(0xFFFFF)).alias("flow_label"),
                _h("total_length").alias("payload_length"),
                _h("ip_protocol").alias("next_header"),
                _h("ttl").alias("hop_limit"),
                address(data, net + 8, 6).alias("src"),
                address(data, net + 24, 6).alias("dst"),
            ),
        ),
        "src_ip": F.when(_h("ip") == 4, address(data, net + 12, 4)).when(_h("ip") == 6, address(data, net + 8, 6)),
        "dst_ip": F.when(_h("ip") == 4, address(data, net + 16, 4)).when(_h("ip") == 6, address(data, net + 24, 6)),
        "src_port": _h("src_port"),
        "dst_port": _h("dst_port"),
        "tcp": F.when(
            _h("layer") == 6,
            F.struct(
                _h("src_port").alias("src_port"),
                _h("dst_port").alias("dst_port"),
                _h("seq").alias("seq"),
                _h("ack").alias("ack"),
                _h("tcp_header").alias("header_length"),
                _h("tcp_flags").alias("flags"),
                _h("window").alias("window"),
                _h("checksum").alias("checksum"),
                _h("checksum_valid").alias("checksum_valid"),
                F.get(F.transform(F.filter(_h("tcp_options"), lambda o: (o["kind"] == 2) & (o["size"] >= 2)), lambda o: small(data, o["at"], 2)), F.lit(0)).alias("mss"),
                _frame_options(_h("tcp_options"), lambda o: named(o["kind"], TCP_OPTIONS, "kind %d"), _tcp_option_value).alias("options"),
            ),
        ),
        "udp": F.when(_h("layer") == 17, F.struct(_h("src_port").alias("src_port"), _h("dst_port").alias("dst_port"), _h("udp_length").alias("length"), _h("checksum").alias("checksum"), _h("checksum_valid").alias("checksum_valid"))),
        "icmp": F.when(
            _h("layer") == 1,
            F.struct(
                _h("icmp_type").alias("type"),
                _h("icmp_code").alias("code"),
                _h("checksum").alias("checksum"),
                _h("icmp_id").alias("id"),
                _h("icmp_sequence").alias("sequence"),
                six.alias("ipv6"),
                _h("checksum_valid").alias("checksum_valid"),
                icmp_name(_h("icmp_type"), _h("icmp_code"), six).alias("description"),
                F.when(~six & (_h("icmp_type") == 5), address(data, at + 4, 4)).alias("gateway"),
            ),
        ),
        "payload": F.when(_h("body").isNotNull(), part(data, _h("body"), _h("body_size"))),
        "fragment": _h("fragment"),
        "malformed": _h("reason").isNotNull(),
        "reason": F.get(F.array(*map(F.lit, REASONS)), _h("reason")),
        # what is read of a frame that neither breaks off nor ends in fragments
        "_arp": F.coalesce(_h("arp"), F.lit(False)),
        "_app": _h("layer").isin(6, 17) & ((_h("layer") == 17) | (_h("tcp_header").between(20, 60) & (_h("reason").isNull()))),
        "_layer": F.coalesce(_h("layer"), F.lit(0)),
        "_proto": _h("proto"),
        "_ip": F.coalesce(_h("ip"), F.lit(0)),
    }


@built_once
def _candidates() -> dict[str, Column]:
    """The payload where it may be that of an application; each in a column of its own."""
    payload, low = F.col("payload"), F.least("src_port", "dst_port")
    some = F.col("_app") & (F.octet_length(payload) > 0)
    port_in = lambda ports: F.col("src_port").isin(*ports) | F.col("dst_port").isin(*ports)
    udp = F.col("_layer") == 17
    prefixed = ~udp & (F.octet_length(payload) >= 14) & (small(payload, 0, 2) + 2 <= F.octet_length(payload))
    dns = F.when(prefixed, part(payload, 2, F.octet_length(payload))).otherwise(payload)
    tls = port_in(TLS_PORTS) | ((F.octet_length(payload) >= 6) & small(payload, 0).between(20, 24) & small(payload, 1, 2).isin(0x0300, 0x0301, 0x0303))
    return {
        "_dhcp": F.when(some & udp & low.isin(67, 68), payload),
        "_ntp": F.when(some & udp & (low == 123), payload),
        "_dns": F.when(some & port_in(DNS_PORTS), dns),
        "_http": F.when(some & (port_in(HTTP_PORTS) | app.looks_like_http(payload)), payload),
        "_tls": F.when(some & tls, payload),
    }


@built_once
def _walked() -> dict[str, Column]:
    return {"_dhcp_at": app.dhcp(F.col("_dhcp")), "_dns_message": app.dns(F.col("_dns")), "_tls_segment": app.tls(F.col("_tls"))}


@built_once
def _kind() -> dict[str, Column]:
    """Which application it is, by small expressions, so that asking for one builds none of the others."""
    return {
        "_kind": F.when(F.col("_dhcp_at").isNotNull(), "dhcp")
        .when(app.is_ntp(F.col("_ntp")), "ntp")
        .when(F.col("_dns_message").isNotNull(), "dns")
        .when(app.is_http(F.col("_http")), "http")
        .when(F.col("_tls_segment").isNotNull(), "tls")
        .otherwise("")
    }


@built_once
def _applications() -> dict[str, Column]:
    """Application structs; the first in the order DHCP, NTP, DNS, HTTP, TLS counts."""
    of = lambda name, value: F.when(F.col("_kind") == name, value)
    return {
        "dhcp": of("dhcp", app.dhcp_fields(F.col("_dhcp"), F.col("_dhcp_at"))),
        "ntp": of("ntp", app.ntp(F.col("_ntp"))),
        "dns": of("dns", F.col("_dns_message")),
        "http": of("http", app.http(F.col("_http"))),
        "tls": of("tls", F.col("_tls_segment")),
    }


@built_once
def _summary() -> dict[str, Column]:
    layer, version = F.col("_layer"), F.col("_ip")
    known = {"arp": F.col("_arp"), "ipv4": version == 4, "ipv6": version == 6, "tcp": layer == 6, "udp": layer == 17, "icmp": layer == 1, **{n: F.col("_kind") == n for n in ("dns", "dhcp", "http", "tls", "ntp")}}
    present = lambda c: known.get(c, F.col(c).isNotNull())
    six = F.col("_proto") == 58
    plain = F.coalesce(named(F.col("ether_type"), ETHER_TYPES, None), F.concat(F.lit("EtherType 0x"), F.lower(F.lpad(F.hex("ether_type"), 4, "0"))))
    protocol = (
        F.when(present("arp"), "ARP")
        .when(present("icmp"), F.when(six, "ICMPv6").otherwise("ICMP"))
        .when(present("dns"), "DNS")
        .when(present("dhcp"), "DHCP")
        .when(present("ntp"), "NTP")
        .when(present("http"), "HTTP")
        .when(present("tls"), F.when(F.col("_tls_segment.version") >= 0x0303, "TLSv1.2").otherwise("TLSv1.0"))
        .when(present("tcp"), "TCP")
        .when(present("udp"), "UDP")
        .when(present("ipv4"), F.when(F.col("fragment"), "IPv4 fragment").otherwise("IPv4"))
        .when(present("ipv6"), "IPv6")
        .when(~F.col("link_type").isin(*KNOWN), F.concat(F.lit("linktype "), N.link_name(F.col("link_type"))))
        .when(F.col("ether_type").isNull() | (F.col("eth").isNull() & F.col("ether_type").isin(IPV4, IPV6, ARP)), "UNKNOWN")
        .otherwise(plain)
    )
    application = [(n, present(n)) for n in ("dns", "dhcp", "http", "tls", "ntp")]
    data = F.col("_app") & (F.octet_length("payload") > 0) & (F.col("_kind") == "")
    names = [("eth", present("eth")), ("sll", present("sll")), ("arp", present("arp")), ("ip", present("ipv4")), ("ipv6", present("ipv6")), ("icmpv6", present("icmp") & six), ("icmp", present("icmp") & ~six), ("tcp", present("tcp")), ("udp", present("udp")), *application, ("data", data)]
    listed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in names[:2]]))
    layers = F.concat(listed, F.transform("vlans", lambda _: F.lit("vlan")), F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in names[2:]])))
    return {"protocol": protocol, "layers": layers, "truncated": F.col("orig_len") > F.col("cap_len"), "summary": info.application()}


@built_once
def _line() -> dict[str, Column]:
    return {"info": info.line()}


#: What ``decode`` adds to the columns that it is given.
ADDED = (
    "ether_type", "ip_protocol", "eth", "sll", "vlans", "arp", "ipv4", "ipv6", "src_ip", "dst_ip", "src_port", "dst_port", "tcp", "udp", "icmp", "payload", "fragment", "malformed", "reason",
    "dhcp", "ntp", "dns", "http", "tls", "protocol", "layers", "truncated", "summary", "info",
)


def decode(frames: DataFrame) -> DataFrame:
    """Raw frames (number, ts_us, link_type, interface, frame, cap_len, orig_len) with all layers beside them.

    ``reason`` says where a malformed frame breaks off, ``info`` what a frame says in one line.
    Every frame is read once, so filters on raw columns belong before this and not behind it.
    """
    small_batches(frames.sparkSession)
    out = frames.select("*", layout(F.col("frame"), F.col("link_type")).alias("_h"))
    for step in (_headers, _candidates, _walked, _kind, _applications, _summary, _line):
        out = out.select("*", *[c.alias(n) for n, c in step().items()])
    return out.select(*frames.columns, *ADDED)


def to_logical(packets: DataFrame) -> DataFrame:
    """Decoded frames as the flat table that statistics and flows take."""
    proto = F.when(F.col("tcp").isNotNull(), "tcp").when(F.col("udp").isNotNull(), "udp").when(F.col("icmp").isNotNull(), "icmp").otherwise("other")
    kind = F.when(F.col("arp").isNotNull(), "arp").when(F.col("dns").isNotNull(), "dns").when(F.col("http").isNotNull(), "http").when(F.col("tls").isNotNull(), "tls").when(F.col("dhcp").isNotNull(), "dhcp").when(F.col("ntp").isNotNull(), "ntp").otherwise(proto)
    asked = F.get("dns.questions", F.lit(0))
    return packets.select(
        "number",
        "ts_us",
        kind.alias("kind"),
        proto.alias("proto"),
        "protocol",
        F.when(F.col("ipv4").isNotNull(), 4).when(F.col("ipv6").isNotNull(), 6).otherwise(0).alias("ip_version"),
        F.col("src_ip.text").alias("src_ip"),
        F.col("dst_ip.text").alias("dst_ip"),
        F.col("src_ip.key").alias("src_ip_key"),
        F.col("dst_ip.key").alias("dst_ip_key"),
        F.col("arp.opcode").alias("arp_opcode"),
        F.col("arp.sender_ip.text").alias("arp_sender_ip"),
        F.col("arp.target_ip.text").alias("arp_target_ip"),
        F.col("arp.sender_ip.key").alias("arp_sender_key"),
        F.col("arp.target_ip.key").alias("arp_target_key"),
        F.col("eth.src").alias("src_mac"),
        F.col("eth.dst").alias("dst_mac"),
        "src_port",
        "dst_port",
        F.coalesce("tcp.flags", F.lit(0)).alias("tcp_flags"),
        F.coalesce("tcp.seq", F.lit(0).cast("long")).alias("seq"),
        F.coalesce("tcp.ack", F.lit(0).cast("long")).alias("ack"),
        F.coalesce(F.octet_length("payload"), F.lit(0)).alias("payload_len"),
        F.octet_length("frame").alias("frame_len"),
        F.get("vlans", F.lit(0))["id"].alias("vlan_id"),
        F.coalesce("ipv4.ttl", "ipv6.hop_limit", F.lit(0)).alias("ttl"),
        F.coalesce("tcp.window", F.lit(0)).alias("tcp_window"),
        F.coalesce("ipv4.checksum_valid", F.lit(True)).alias("ip_checksum_ok"),
        F.coalesce(F.col("tcp.checksum_valid") | (F.col("tcp.checksum") == 0), F.col("udp.checksum_valid"), F.lit(True)).alias("l4_checksum_ok"),
        "truncated",
        "malformed",
        F.col("reason").alias("malformed_reason"),
        "fragment",
        F.col("icmp.type").alias("icmp_type"),
        F.col("icmp.code").alias("icmp_code"),
        asked["name"].alias("dns_qname"),
        F.when(F.col("dns").isNotNull(), ~F.col("dns.is_query")).alias("dns_response"),
        named(asked["type"], DNS_FLOW_TYPES, "TYPE%d").alias("dns_type"),
        named(F.col("dns.rcode"), DNS_RCODES, "rcode %d").alias("dns_rcode"),
        F.when(F.size("dns.answers") > 0, N.answers_text(F.transform("dns.answers", lambda a: a["data"]))).alias("dns_answer"),
        F.when(F.col("http.request"), F.col("http.method")).alias("http_method"),
        F.col("http.host").alias("http_host"),
        F.col("http.uri").alias("http_uri"),
        F.col("http.status_code").alias("http_status"),
        F.when(~F.col("http.request"), F.col("http.reason")).alias("http_reason"),
        F.col("tls.sni").alias("tls_sni"),
        F.col("tls.version").alias("tls_version"),
        F.get("tls.cipher_suites", F.lit(0)).alias("tls_suite"),
        "summary",
        "info",
    )
