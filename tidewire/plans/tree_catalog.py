"""Trees of decoded packets; the SQL writes every line from logical columns and sizes that it adds up itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.decode.frames import decode
from tidewire.operators.documents import documents
from tidewire.operators.layers import tree_lines
from tidewire.plans.bridge import PACKETS_CTE
from tidewire.plans.frames import frames
from tidewire.plans.report_catalog import _ECHO, _info_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without the digits of checksums, which SQL does not add up, and without previews of binary payloads."""
    lines = tree_lines(decode(frames(spark, sf_dir))).withColumn("line", F.regexp_replace("line", "hecksum: 0x[0-9a-f]{4}", "hecksum:"))
    printed = F.regexp_like(F.col("line"), F.lit("^  ASCII: [^.]{3}")) | ~F.col("line").startswith("  ASCII: ")
    return lines.where(printed)


_INFO = _info_sql(_ECHO, "case when tcp_flags = 2 then ' MSS=1460' else '' end")
_VENDOR = "case when {0} like '00:50:56:%' then ' (VMware)' else '' end"
_NETWORK = "case when kind = 'arp' then 'ARP (0x0806)' when ip_version = 6 then 'IPv6 (0x86dd)' else 'IPv4 (0x0800)' end"
_SAID = """case kind when 'http' then case when http_method is not null then http_method || ' ' || http_uri || ' HTTP/1.1..Host: ' || http_host || '..User-Agent: probe....' else 'HTTP/1.1 ' || http_status || ' ' || http_reason || '..Server: demo..Content-Length: 2....ok' end
  when 'icmp' then 'abcdefgh' when 'tcp' then repeat('Z', payload_len) end"""
_DATA = "case dns_record when 'A' then 4 when 'AAAA' then 16 when 'MX' then 10 when 'TXT' then length(dns_answer) + 1 when 'CNAME' then 9 when 'SOA' then 33 when 'SRV' then 12 else length(dns_answer) - 1 end"
_SIZED = f"""select *, {_INFO} as info, case kind when 'dns' then length(dns_qname) + 18 + case when dns_answer is null then 0 else 12 + {_DATA} end when 'tls' then case when tls_sni <> '' then 63 + length(tls_sni) else 9 end when 'arp' then 0 else length({_SAID}) end as body,
  case when proto = 'tcp' then case when tcp_flags = 2 then 32 else 20 end else 8 end as head,
  case when kind = 'tls' then 'TLSv1.2' when kind = 'icmp' and ip_version = 6 then 'ICMPv6' else protocol end as named from packets"""
_FLAGS = "case when tcp_flags = 0 then 'none' else concat_ws(',', case when tcp_flags & 1 > 0 then 'FIN' end, case when tcp_flags & 2 > 0 then 'SYN' end, case when tcp_flags & 4 > 0 then 'RST' end, case when tcp_flags & 8 > 0 then 'PSH' end, case when tcp_flags & 16 > 0 then 'ACK' end) end"
_ICMP = "case icmp_type when 128 then 'ICMPv6 echo request' when 129 then 'ICMPv6 echo reply' when 8 then 'Echo request (ping)' when 0 then 'Echo reply (ping)' else case icmp_code when 0 then 'Destination network unreachable' when 1 then 'Destination host unreachable' else 'Destination unreachable' end end"
_STACK = "'eth' || case when vlan_id is not null then ':vlan' else '' end || case when kind = 'arp' then ':arp' else case ip_version when 6 then ':ipv6' else ':ip' end || case kind when 'icmp' then case ip_version when 6 then ':icmpv6' else ':icmp' end when 'dns' then ':udp:dns' when 'http' then ':tcp:http' when 'tls' then ':tcp:tls' else case when body > 0 then ':tcp:data' else ':tcp' end end end"
_SIZE = "(14 + case when vlan_id is not null then 4 else 0 end + case when kind = 'arp' then 28 else case when ip_version = 6 then 40 else 20 end + head + body end)"


def _when(condition: str, *lines: str) -> str:
    """A list of lines, those of a layer."""
    return f"case when {condition} then [{', '.join(lines)}] else [] end"


_SECTIONS = (
    f"""[('Frame ' || number || ': ' || {_SIZE} || ' bytes' || case when truncated then ' (on wire: ' || ({_SIZE} + 10) || ')' else '' end), '  Arrival time: ' || strftime(make_timestamp(ts_us), '%Y-%m-%d %H:%M:%S.%f'), '  Link type: EN10MB (Ethernet)',
    '  Protocols: ' || {_STACK}, '  Protocol: ' || named, '  Info: ' || info, case when truncated then '  Frame is truncated' end]""",
    f"['Ethernet II, Src: ' || src_mac || ', Dst: ' || dst_mac, '  Destination: ' || dst_mac || {_VENDOR.format('dst_mac')}, '  Source: ' || src_mac || {_VENDOR.format('src_mac')}, '  Type: ' || case when vlan_id is not null then '802.1Q VLAN (0x8100)' else {_NETWORK} end]",
    _when("vlan_id is not null", "'802.1Q VLAN tag, ID: ' || vlan_id || ', PRI: 0'", f"'  Inner EtherType: ' || {_NETWORK}"),
    _when(
        "kind = 'arp'",
        "'Address Resolution Protocol (' || case arp_opcode when 1 then 'request' else 'reply' end || ')'",
        "'  Hardware type: 1 (Ethernet)'",
        "'  Protocol type: IPv4 (0x0800)'",
        "'  Opcode: ' || arp_opcode || case arp_opcode when 1 then ' (request)' else ' (reply)' end",
        f"'  Sender MAC: ' || src_mac || {_VENDOR.format('src_mac')}",
        "'  Sender IP: ' || arp_sender_ip",
        "'  Target MAC: 00:00:00:00:00:00'",
        "'  Target IP: ' || arp_target_ip",
    ),
    _when(
        "ip_version = 4",
        "'Internet Protocol Version 4, Src: ' || src_ip || ', Dst: ' || dst_ip",
        "'  Version: 4'",
        "'  Header length: 20 bytes'",
        "'  DSCP: 0, ECN: 0'",
        "'  Total length: ' || (20 + head + body)",
        "'  Identification: 0x' || printf('%04x', number % 65536)",
        "'  Flags: 0x40 Don''t fragment'",
        "'  Fragment offset: 0'",
        "'  Time to live: ' || ttl",
        "'  Protocol: ' || case proto when 'tcp' then 'TCP (6)' when 'udp' then 'UDP (17)' else 'ICMP (1)' end",
        "'  Header checksum:' || case when ip_checksum_ok then ' [valid]' else ' [invalid]' end",
        "'  Source: ' || src_ip || ' (private)'",
        "'  Destination: ' || dst_ip || ' (private)'",
    ),
    _when(
        "ip_version = 6",
        "'Internet Protocol Version 6, Src: ' || src_ip || ', Dst: ' || dst_ip",
        "'  Traffic class: 0'",
        "'  Flow label: 0x00000'",
        "'  Payload length: ' || (head + body)",
        "'  Next header: ' || case proto when 'tcp' then 'TCP' when 'udp' then 'UDP' else 'ICMPv6' end",
        "'  Hop limit: ' || ttl",
    ),
    _when(
        "kind = 'icmp'",
        f"case when ip_version = 6 then 'ICMPv6: ' else 'Internet Control Message Protocol: ' end || {_ICMP}",
        "'  Type: ' || icmp_type || ', Code: ' || icmp_code",
        "'  Checksum: invalid/unverified'",
        "case when icmp_type <> 3 then '  Identifier: 0x' || printf('%04x', number % 65536) || ', Sequence: 1' end",
        "'  Embedded data: 8 bytes'",
    ),
    _when(
        "proto = 'tcp'",
        "'Transmission Control Protocol, Src Port: ' || src_port || ', Dst Port: ' || dst_port || ', Seq: ' || seq",
        "'  Source port: ' || src_port",
        "'  Destination port: ' || dst_port",
        "'  Sequence number: ' || seq",
        "'  Acknowledgement number: ' || ack",
        "'  Header length: ' || head || ' bytes'",
        f"'  Flags: 0x' || printf('%03x', tcp_flags) || ' (' || {_FLAGS} || ')'",
        "'  Window size: ' || tcp_window",
        "'  Checksum:' || case when l4_checksum_ok then ' [valid]' else ' [invalid]' end",
        *[f"case when tcp_flags = 2 then '  Option: {o}' {more} end" for o, more in (("MSS = 1460", ""), ("SACK permitted", ""), ("Window scale = ", "|| (number % 10)"), ("NOP", ""), ("End of options", ""))],
    ),
    _when("proto = 'udp'", "'User Datagram Protocol, Src Port: ' || src_port || ', Dst Port: ' || dst_port", "'  Length: ' || (8 + body)", "'  Checksum:' || case when l4_checksum_ok then ' [valid]' else ' [invalid]' end"),
    _when(
        "kind = 'dns'",
        "'Domain Name System (' || case when dns_response then 'response)' else 'query)' end",
        "'  Transaction ID: 0x' || printf('%04x', number % 65536)",
        "'  Flags: ' || case when dns_response then 'response, RD, RA' else 'query, RD' end",
        "case when dns_response then '  Reply code: ' || dns_rcode end",
        "'  Query: ' || dns_qname || ' type ' || dns_record",
        "case when dns_answer is not null then '  Answer: ' || dns_qname || ' ' || dns_record || ' ' || dns_answer end",
    ),
    _when(
        "kind = 'http'",
        "case when http_method is not null then 'Hypertext Transfer Protocol (request)' else 'Hypertext Transfer Protocol (response)' end",
        "case when http_method is not null then '  Request method: ' || http_method end",
        "case when http_method is not null then '  Request URI: ' || http_uri end",
        "case when http_method is null then '  Status code: ' || http_status || ' ' || http_reason end",
        "'  Request version: HTTP/1.1'",
        "case when http_method is not null then '  Host: ' || http_host end",
        "case when http_method is not null then '  User-Agent: probe' end",
        "case when http_method is null then '  Server: demo' end",
        "case when http_method is null then '  Content-Length: 2' end",
        "case when http_method is null then '  Body: 2 bytes' end",
    ),
    _when(
        "kind = 'tls'",
        "'Transport Layer Security'",
        "case when tls_sni <> '' then '  Client Hello (TLS 1.2, ' || (54 + length(tls_sni)) || ' bytes) (' || (58 + length(tls_sni)) || ' bytes)' else '  Application Data (TLS 1.2) (4 bytes)' end",
        "case when tls_sni <> '' then '  Server Name Indication: ' || tls_sni end",
        "case when tls_sni <> '' then '  Cipher suite: TLS_AES_128_GCM_SHA256' end",
        "case when tls_sni <> '' then '  Cipher suite: TLS_AES_256_GCM_SHA384' end",
    ),
    _when("body > 0", "'Payload (' || body || ' bytes)'", f"case when length({_SAID}) > 2 then '  ASCII: ' || substr({_SAID}, 1, 96) end"),
)
QUERIES["packet_tree"] = _tree
ORACLES["packet_tree"] = f"""{PACKETS_CTE}, sized as ({_SIZED}), listed as (select number, list_filter(flatten([{", ".join(_SECTIONS)}]), lambda x: x is not null) as lines from sized)
  select number, (unnest(range(1, len(lines) + 1)) - 1)::int as position, unnest(lines) as line from listed"""


#: Paths into a packet's document, the type of their value, and the SQL of the same.
_PATHS: tuple[tuple[str, str, str, str], ...] = (
    ("length", "$.length", "bigint", _SIZE),
    ("original", "$.original_length", "bigint", f"{_SIZE} + case when truncated then 10 else 0 end"),
    ("protocols", "$.protocols", "string", _STACK),
    ("info", "$.info", "string", "info"),
    ("src", "$.src", "string", "case when kind = 'arp' then src_mac when proto in ('tcp', 'udp') then src_ip || ':' || src_port else src_ip end"),
    ("dst", "$.dst", "string", "case when kind = 'arp' then arp_target_ip when proto in ('tcp', 'udp') then dst_ip || ':' || dst_port else dst_ip end"),
    ("flow_key", "$.flow_key", "string", "case when kind = 'arp' then 'arp:' || arp_sender_ip || ':' || arp_target_ip else case proto when 'tcp' then '6:' when 'udp' then '17:' else case when ip_version = 6 then '58:' else '1:' end end || case when (src_ip_key, src_port) < (dst_ip_key, dst_port) then src_ip || ':' || src_port || ':' || dst_ip || ':' || dst_port else dst_ip || ':' || dst_port || ':' || src_ip || ':' || src_port end end"),
    ("vendor", "$.ethernet.src_vendor", "string", "case when src_mac like '00:50:56:%' then 'VMware' end"),
    ("vlan", "$.vlans[0].id", "bigint", "vlan_id"),
    ("operation", "$.arp.operation", "string", "case arp_opcode when 1 then 'request' when 2 then 'reply' end"),
    ("total_length", "$.ip.total_length", "bigint", "case when ip_version = 4 then 20 + head + body end"),
    ("ip_valid", "$.ip.checksum_valid", "boolean", "case when ip_version = 4 then ip_checksum_ok end"),
    ("hop_limit", "$.ipv6.hop_limit", "bigint", "case when ip_version = 6 then ttl end"),
    ("flags", "$.tcp.flags", "string", f"case when proto = 'tcp' then {_FLAGS} end"),
    ("scale", "$.tcp.options[2].value", "bigint", "case when proto = 'tcp' and tcp_flags = 2 then number % 10 end"),
    ("udp_valid", "$.udp.checksum_valid", "boolean", "case when proto = 'udp' then l4_checksum_ok end"),
    ("icmp_id", "$.icmp.id", "bigint", "case when kind = 'icmp' and icmp_type <> 3 then number % 65536 end"),
    ("icmp_text", "$.icmp.description", "string", f"case when kind = 'icmp' then {_ICMP} end"),
    ("rcode", "$.dns.rcode_name", "string", "dns_rcode"),
    ("available", "$.dns.recursion_available", "boolean", "case when kind = 'dns' then dns_response end"),
    ("question", "$.dns.questions[0].type", "string", "dns_record"),
    ("answer", "$.dns.answers[0].data", "string", "dns_answer"),
    ("method", "$.http.method", "string", "http_method"),
    ("status_text", "$.http.status_text", "string", "http_reason"),
    ("second_header", "$.http.headers[1].name", "string", "case when kind = 'http' then case when http_method is not null then 'User-Agent' else 'Content-Length' end end"),
    ("sni", "$.tls.sni", "string", "tls_sni"),
    ("suite", "$.tls.cipher_suites[1]", "string", "case when tls_sni <> '' then 'TLS_AES_256_GCM_SHA384' end"),
    ("payload", "$.payload_length", "bigint", "body"),
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = documents(decode(frames(spark, sf_dir)))
    return made.select("number", *[F.get_json_object("json", path).cast(kind).alias(name) for name, path, kind, _ in _PATHS])


QUERIES["packet_documents"] = _documents
ORACLES["packet_documents"] = f"{PACKETS_CTE}, sized as ({_SIZED}) select number, " + ", ".join(f"({sql}){'::bigint' if kind == 'bigint' else ''} as {name}" for name, _, kind, sql in _PATHS) + " from sized"
