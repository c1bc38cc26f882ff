"""Queries that decode frames; their SQL reads the logical columns and no bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.decode.frames import decode, to_logical
from tidewire.filters.fields import decoded as field
from tidewire.filters.predicates import both, either
from tidewire.operators import stats
from tidewire.plans.bridge import PACKETS_CTE
from tidewire.plans.frames import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(decode(frames(spark, sf_dir)))
    ORACLES[name] = f"{PACKETS_CTE} {sql}"


_IP = "ip_version in (4, 6)"
_add("decode_ethernet", lambda d: d.select("number", "eth.src", "eth.dst", F.get("vlans", F.lit(0))["id"].alias("vlan"), "protocol"), "select number, src_mac as src, dst_mac as dst, vlan_id as vlan, case when kind = 'tls' then 'TLSv1.2' when kind = 'icmp' and ip_version = 6 then 'ICMPv6' else protocol end as protocol from packets")
_add("decode_arp", lambda d: d.where("arp is not null").select("number", "arp.opcode", F.col("arp.sender_ip.text").alias("sender"), F.col("arp.target_ip.key").alias("target")), "select number, arp_opcode as opcode, arp_sender_ip as sender, arp_target_key as target from packets where kind = 'arp'")
_add("decode_ipv4", lambda d: d.where("ipv4 is not null").select("number", F.col("ipv4.src.text").alias("src"), F.col("ipv4.dst.key").alias("dst"), "ipv4.ttl", "ipv4.checksum_valid", "ipv4.df"), "select number, src_ip as src, dst_ip_key as dst, ttl, ip_checksum_ok as checksum_valid, true as df from packets where ip_version = 4")
_add("decode_ipv6", lambda d: d.where("ipv6 is not null").select("number", F.col("ipv6.src.text").alias("src"), F.col("ipv6.dst.key").alias("dst"), F.col("ipv6.hop_limit").alias("ttl")), "select number, src_ip as src, dst_ip_key as dst, ttl from packets where ip_version = 6")
_add("decode_tcp", lambda d: d.where("tcp is not null").select("number", "tcp.src_port", "tcp.dst_port", "tcp.seq", "tcp.flags", "tcp.window", "tcp.checksum_valid"), "select number, src_port, dst_port, seq, tcp_flags as flags, tcp_window as window, l4_checksum_ok as checksum_valid from packets where proto = 'tcp'")
_add("decode_tcp_options", lambda d: d.where("tcp is not null").select("number", F.col("tcp.mss"), F.array_join(F.transform("tcp.options", lambda o: F.concat(o["name"], F.lit("="), o["value"])), ";").alias("options")), "select number, case when tcp_flags = 2 then 1460 end as mss, case when tcp_flags = 2 then 'MSS=1460;SACK permitted=;Window scale=' || (number % 10) || ';NOP=;End of options=' else '' end as options from packets where proto = 'tcp'")
_add("decode_udp", lambda d: d.where("udp is not null").select("number", "udp.src_port", "udp.dst_port", "udp.length", "udp.checksum_valid"), "select number, src_port, dst_port, length(dns_qname)::int + 18 + 8 + case when dns_answer is null then 0 else 12 + case dns_record when 'A' then 4 when 'AAAA' then 16 when 'MX' then 10 when 'TXT' then length(dns_answer) + 1 when 'CNAME' then 9 when 'SOA' then 33 when 'SRV' then 12 else length(dns_answer) - 1 end end as length, l4_checksum_ok as checksum_valid from packets where proto = 'udp'")
_add("decode_icmp", lambda d: d.where("icmp is not null").select("number", "icmp.type", F.col("icmp.id").cast("long").alias("id"), "icmp.description"), "select number, icmp_type as type, case when icmp_type <> 3 then number % 65536 end as id, case icmp_type when 128 then 'ICMPv6 echo request' when 129 then 'ICMPv6 echo reply' when 8 then 'Echo request (ping)' when 0 then 'Echo reply (ping)' else case icmp_code when 0 then 'Destination network unreachable' when 1 then 'Destination host unreachable' else 'Destination unreachable' end end as description from packets where kind = 'icmp'")
_add("decode_dns", lambda d: d.where("dns is not null").select("number", F.get("dns.questions", F.lit(0))["name"].alias("qname"), F.get("dns.questions", F.lit(0))["type_name"].alias("qtype"), "dns.is_query", "dns.valid", F.get("dns.answers", F.lit(0))["data"].alias("answer"), F.get("dns.answers", F.lit(0))["name"].alias("answer_name")), "select number, dns_qname as qname, dns_record as qtype, not dns_response as is_query, true as valid, dns_answer as answer, case when dns_answer is not null then dns_qname end as answer_name from packets where kind = 'dns'")
_add("decode_http", lambda d: d.where("http is not null").select("number", "http.method", "http.uri", "http.host", "http.status_code", "http.content_length"), "select number, coalesce(http_method, '') as method, http_uri as uri, http_host as host, http_status as status_code, case when http_method is null then 2 else -1 end as content_length from packets where kind = 'http'")
_add("decode_tls", lambda d: d.where("tls is not null").select("number", "tls.sni", "tls.handshake_type", F.size("tls.cipher_suites").alias("suites")), "select number, tls_sni as sni, case when tls_sni <> '' then 1 else 0 end as handshake_type, case when tls_sni <> '' then 2 else 0 end as suites from packets where kind = 'tls'")
_add("decode_layers", lambda d: d.groupBy(F.array_join("layers", ":").alias("layers")).agg(F.count(F.lit(1)).alias("packets"), F.count_if("malformed").alias("malformed"), F.count_if("truncated").alias("truncated")), "select 'eth' || case when vlan_id is not null then ':vlan' else '' end || case when kind = 'arp' then ':arp' else case ip_version when 6 then ':ipv6' else ':ip' end || case kind when 'icmp' then case ip_version when 6 then ':icmpv6' else ':icmp' end when 'dns' then ':udp:dns' when 'http' then ':tcp:http' when 'tls' then ':tcp:tls' else case when payload_len > 0 then ':tcp:data' else ':tcp' end end end as layers, count(*) as packets, 0::bigint as malformed, count_if(truncated)::bigint as truncated from packets group by 1")
_add("decode_filter_bytes", lambda d: d.where(both(field("payload").contains(b"Host: www2"), field("tcp.port") == 80)).select("number"), "select number from packets where http_method is not null and http_host = 'www2.example.org' and (src_port = 80 or dst_port = 80)")
_add("decode_filter_fields", lambda d: d.where(either(field("dns.qry.name").matches(r"^host1\d\."), field("tls.sni") == "api2.example.net", both(field("vlan").exists(), field("ip.addr") == "10.0.0.0/27"))).select("number"), "select number from packets where regexp_matches(dns_qname, '^host1\\d\\.') or tls_sni = 'api2.example.net' or (vlan_id is not null and (src_ip_key between '040a000000' and '040a00001f' or dst_ip_key between '040a000000' and '040a00001f'))")
_add("decode_to_endpoints", lambda d: stats.endpoints(to_logical(d)).select("ip", "tx_packets", "rx_packets", "mac"), "select ip, count_if(sent)::bigint as tx_packets, count_if(not sent)::bigint as rx_packets, coalesce(arg_max(mac, number) filter (sent), arg_min(mac, number) filter (not sent)) as mac from (select number, src_ip as ip, true as sent, src_mac as mac from packets where src_ip is not null union all select number, dst_ip, false, dst_mac from packets where dst_ip is not null) group by ip")
_add("checksum_verify", lambda d: to_logical(d).groupBy("protocol").agg(F.count_if(~F.col("ip_checksum_ok")).alias("bad_ip"), F.count_if(~F.col("l4_checksum_ok")).alias("bad_l4")), "select case when kind = 'icmp' and ip_version = 6 then 'ICMPv6' else protocol end as protocol, count_if(ip_version = 4 and not ip_checksum_ok)::bigint as bad_ip, count_if(not l4_checksum_ok)::bigint as bad_l4 from packets group by 1")
