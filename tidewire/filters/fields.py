"""The fields that predicates know, over logical packets and over decoded frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.filters.predicates import Entry, Registry

_TCP, _UDP = "proto = 'tcp'", "proto = 'udp'"


def _flag(bit: int) -> str:
    return f"if(proto = 'tcp', (tcp_flags & {bit}) <> 0, null)"


def _present(values: str) -> str:
    return f"filter(array({values}), x -> x is not null)"


#: Fields of logical packets (the flat table of :mod:`tidewire.plans.bridge`).
logical = Registry(
    [
        Entry("frame.number", "int", "number"),
        Entry("frame.time", "int", "ts_us div 1000000"),
        Entry("frame.len", "int", "frame_len"),
        Entry("frame.truncated", "bool", "truncated"),
        Entry("eth.src", "string", "src_mac"),
        Entry("eth.dst", "string", "dst_mac"),
        Entry("eth.addr", "string", "array(src_mac, dst_mac)", True),
        Entry("vlan", "bool", "vlan_id is not null"),
        Entry("vlan.id", "int", "vlan_id"),
        Entry("arp", "bool", "kind = 'arp'"),
        Entry("arp.sender_ip", "ip", "arp_sender_key", text_sql="arp_sender_ip"),
        Entry("arp.target_ip", "ip", "arp_target_key", text_sql="arp_target_ip"),
        Entry("ip", "bool", "ip_version = 4"),
        Entry("ipv6", "bool", "ip_version = 6"),
        Entry("ip.version", "int", "nullif(ip_version, 0)"),
        Entry("ip.src", "ip", "src_ip_key", text_sql="src_ip"),
        Entry("ip.dst", "ip", "dst_ip_key", text_sql="dst_ip"),
        Entry("ip.addr", "ip", _present("src_ip_key, dst_ip_key"), True, _present("src_ip, dst_ip")),
        Entry("ip.ttl", "int", "nullif(ttl, 0)"),
        Entry("ip.checksum_bad", "bool", "not ip_checksum_ok"),
        Entry("tcp", "bool", _TCP),
        Entry("tcp.srcport", "int", f"if({_TCP}, src_port, null)"),
        Entry("tcp.dstport", "int", f"if({_TCP}, dst_port, null)"),
        Entry("tcp.port", "int", f"if({_TCP}, array(src_port, dst_port), array())", True),
        Entry("tcp.flags", "int", f"if({_TCP}, tcp_flags, null)"),
        *[Entry(f"tcp.flags.{name}", "bool", _flag(bit)) for name, bit in (("fin", 1), ("syn", 2), ("reset", 4), ("rst", 4), ("push", 8), ("ack", 16), ("urg", 32), ("ece", 64), ("cwr", 128))],
        Entry("tcp.handshake", "bool", f"{_TCP} and (tcp_flags & 6) <> 0"),
        Entry("tcp.seq", "int", f"if({_TCP}, seq, null)"),
        Entry("tcp.window_size", "int", f"if({_TCP}, tcp_window, null)"),
        Entry("tcp.len", "int", f"if({_TCP}, payload_len, null)"),
        Entry("udp", "bool", _UDP),
        Entry("udp.srcport", "int", f"if({_UDP}, src_port, null)"),
        Entry("udp.dstport", "int", f"if({_UDP}, dst_port, null)"),
        Entry("udp.port", "int", f"if({_UDP}, array(src_port, dst_port), array())", True),
        Entry("port", "int", "if(proto in ('tcp', 'udp'), array(src_port, dst_port), array())", True),
        Entry("icmp", "bool", "proto = 'icmp'"),
        Entry("dns", "bool", "kind = 'dns'"),
        Entry("dns.qry.name", "string", "dns_qname"),
        Entry("http", "bool", "kind = 'http'"),
        Entry("http.request.method", "string", "http_method"),
        Entry("http.host", "string", "http_host"),
        Entry("http.request.uri", "string", "http_uri"),
        Entry("http.response.code", "int", "http_status"),
        Entry("tls", "bool", "kind = 'tls'"),
        Entry("ssl", "bool", "kind = 'tls'"),
        Entry("tls.sni", "string", "tls_sni"),
        Entry("payload.len", "int", "nullif(payload_len, 0)"),
    ]
)


def _tcp_flag(bit: int) -> str:
    return f"(tcp.flags & {bit}) <> 0"


def _ip_text(sql: str) -> str:
    return sql.replace(".key", ".text")


def _decoded() -> list[Entry]:
    both_ips = "filter(array(src_ip.key, dst_ip.key), x -> x is not null)"
    e = [
        Entry("frame", "bool", "length(frame) > 0"), Entry("frame.number", "int", "number"), Entry("frame.time", "int", "ts_us div 1000000"), Entry("frame.len", "int", "length(frame)"),
        Entry("frame.cap_len", "int", "cap_len"), Entry("frame.protocols", "string", "array_join(layers, ':')"), Entry("frame.interface", "string", "interface"), Entry("frame.link_type", "int", "link_type"),
        Entry("frame.malformed", "bool", "malformed"), Entry("frame.truncated", "bool", "truncated"), Entry("frame.contains", "bytes", "frame"),
        Entry("eth", "bool", "eth is not null"), Entry("eth.src", "string", "eth.src"), Entry("eth.dst", "string", "eth.dst"), Entry("eth.addr", "string", "filter(array(eth.src, eth.dst), x -> x is not null)", True), Entry("eth.type", "int", "if(eth is not null, ether_type, null)"),
        Entry("vlan", "bool", "size(vlans) > 0"), Entry("vlan.id", "int", "transform(vlans, v -> v.id)", True), Entry("vlan.priority", "int", "transform(vlans, v -> v.priority)", True),
        Entry("arp", "bool", "arp is not null"), Entry("arp.opcode", "int", "arp.opcode"),
        *[Entry(n, "string", "arp.sender_mac") for n in ("arp.src.hw_mac", "arp.sender_mac")], *[Entry(n, "ip", "arp.sender_ip.key", text_sql="arp.sender_ip.text") for n in ("arp.src.proto_ipv4", "arp.sender_ip")],
        *[Entry(n, "string", "arp.target_mac") for n in ("arp.dst.hw_mac", "arp.target_mac")], *[Entry(n, "ip", "arp.target_ip.key", text_sql="arp.target_ip.text") for n in ("arp.dst.proto_ipv4", "arp.target_ip")],
        *[Entry(n, "bool", "ipv4 is not null") for n in ("ip", "ipv4")], *[Entry(f"{v}.src", "ip", "src_ip.key", text_sql="src_ip.text") for v in ("ip", "ipv6")], *[Entry(f"{v}.dst", "ip", "dst_ip.key", text_sql="dst_ip.text") for v in ("ip", "ipv6")],
        *[Entry(f"{v}.addr", "ip", both_ips, True, _ip_text(both_ips)) for v in ("ip", "ipv6")], *[Entry(n, "int", "coalesce(ipv4.ttl, ipv6.hop_limit)") for n in ("ip.ttl", "ipv6.hlim")],
        Entry("ip.id", "int", "ipv4.identification"), Entry("ip.flags", "int", "if(ipv4 is null, null, if(ipv4.df, 2, 0) + if(ipv4.mf, 1, 0))"), Entry("ip.frag_offset", "int", "ipv4.fragment_offset"), Entry("ip.proto", "int", "ip_protocol"),
        Entry("ip.len", "int", "coalesce(ipv4.total_length, ipv6.payload_length + 40)"), Entry("ip.checksum", "int", "ipv4.checksum"), Entry("ip.checksum_bad", "bool", "not ipv4.checksum_valid"), Entry("ip.version", "int", "case when ipv4 is not null then 4 when ipv6 is not null then 6 end"),
        Entry("ipv6", "bool", "ipv6 is not null"), Entry("ipv6.nxt", "int", "ipv6.next_header"), Entry("ipv6.flow", "int", "ipv6.flow_label"),
        Entry("tcp", "bool", "tcp is not null"), Entry("tcp.srcport", "int", "tcp.src_port"), Entry("tcp.dstport", "int", "tcp.dst_port"), Entry("tcp.port", "int", "if(tcp is null, array(), array(tcp.src_port, tcp.dst_port))", True), Entry("tcp.flags", "int", "tcp.flags"),
        *[Entry(f"tcp.flags.{n}", "bool", _tcp_flag(b)) for n, b in (("syn", 2), ("ack", 16), ("fin", 1), ("reset", 4), ("rst", 4), ("push", 8), ("urg", 32), ("ece", 64), ("cwr", 128))],
        Entry("tcp.handshake", "bool", "coalesce((tcp.flags & 6) <> 0, false)"), Entry("tcp.seq", "int", "tcp.seq"), Entry("tcp.ack", "int", "tcp.ack"), Entry("tcp.window_size", "int", "tcp.window"), Entry("tcp.len", "int", "if(tcp is not null, length(payload), null)"),
        Entry("tcp.checksum", "int", "tcp.checksum"), Entry("tcp.checksum_bad", "bool", "not tcp.checksum_valid and tcp.checksum <> 0"), Entry("tcp.options.mss_val", "int", "tcp.mss"),
        Entry("udp", "bool", "udp is not null"), Entry("udp.srcport", "int", "udp.src_port"), Entry("udp.dstport", "int", "udp.dst_port"), Entry("udp.port", "int", "if(udp is null, array(), array(udp.src_port, udp.dst_port))", True), Entry("udp.length", "int", "udp.length"),
        Entry("udp.checksum", "int", "udp.checksum"), Entry("udp.checksum_bad", "bool", "not udp.checksum_valid and udp.checksum <> 0"), Entry("port", "int", "if(tcp is null and udp is null, array(), array(src_port, dst_port))", True),
        Entry("icmp", "bool", "icmp is not null"), Entry("icmp.type", "int", "icmp.type"), Entry("icmp.code", "int", "icmp.code"), Entry("icmp.ident", "int", "icmp.id"), Entry("icmp.seq", "int", "icmp.sequence"),
        Entry("dns", "bool", "dns is not null"), Entry("dns.id", "int", "dns.id"), Entry("dns.flags.response", "bool", "not dns.is_query"), Entry("dns.rcode", "int", "dns.rcode"), Entry("dns.count.answers", "int", "if(dns is null, null, size(dns.answers))"),
        Entry("dns.qry.name", "string", "transform(dns.questions, q -> q.name)", True), Entry("dns.resp.name", "string", "transform(dns.answers, a -> a.name)", True), Entry("dns.resp.type", "int", "transform(dns.answers, a -> a.type)", True),
        *[Entry(f"dns.{n}", "ip", f"transform(filter(dns.answers, a -> a.type = {t}), a -> a.key)", True, f"transform(filter(dns.answers, a -> a.type = {t}), a -> a.data)") for n, t in (("a", 1), ("aaaa", 28))], Entry("dns.cname", "string", "transform(filter(dns.answers, a -> a.type = 5), a -> a.data)", True),
        Entry("http", "bool", "http is not null"), Entry("http.request", "bool", "http.request"), Entry("http.response", "bool", "not http.request"), Entry("http.request.method", "string", "http.method"), Entry("http.request.uri", "string", "http.uri"), Entry("http.response.code", "int", "http.status_code"),
        *[Entry(f"http.{n}", "string", f"http.{n}") for n in ("host", "user_agent", "content_type", "server", "cookie")], Entry("http.content_length", "int", "http.content_length"),
        *[Entry(n, "bool", "tls is not null") for n in ("tls", "ssl")], Entry("tls.handshake.type", "int", "tls.handshake_type"), *[Entry(n, "string", "tls.sni") for n in ("tls.handshake.extensions_server_name", "tls.sni")],
        Entry("tls.record.content_type", "int", "transform(tls.records, r -> r.content_type)", True), Entry("tls.record.version", "int", "transform(tls.records, r -> r.version)", True), Entry("tls.handshake.ciphersuite", "string", "tls.cipher_suites", True),
        *[Entry(n, "bool", "dhcp is not null") for n in ("dhcp", "bootp")], Entry("dhcp.option.dhcp", "int", "dhcp.message_type"), Entry("dhcp.hw.mac_addr", "string", "dhcp.client_mac"),
        Entry("ntp", "bool", "ntp is not null"), Entry("ntp.mode", "int", "ntp.mode"), Entry("ntp.stratum", "int", "ntp.stratum"),
        *[Entry(n, "bytes", "if(length(payload) > 0, payload, null)") for n in ("data", "payload")], *[Entry(n, "int", "nullif(length(payload), 0)") for n in ("data.len", "payload.len")],
    ]
    return e


#: Fields of decoded frames (the nested table of :mod:`tidewire.decode.frames`).
decoded = Registry(_decoded())


def field_table(spark: SparkSession, registry: Registry = decoded, search: str = "") -> DataFrame:
    """(name, kind, expression) of the known fields."""
    return spark.createDataFrame(registry.rows(search), "name string, kind string, expression string")
