"""Every query over the test tables by name, each with SQL that computes the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.filters.fields import logical as field
from tidewire.filters.predicates import both, either, negate, total
from tidewire.functions import ip as IP
from tidewire.functions import packet as P
from tidewire.functions import text as X
from tidewire.functions.lookups import SERVICES, vendor_name
from tidewire.operators import flows as W, signatures
from tidewire.operators import ring, scans, stats, store
from tidewire.plans.bridge import PACKETS_CTE, packets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None, cte: str = PACKETS_CTE) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = f"{cte}{sql}" if cte else sql


def _over_packets(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    _add(name, lambda spark, sf_dir: build(packets(spark, sf_dir)), sql and " " + sql)


_SERVICES_SQL = "(values " + ", ".join(f"({p}, '{proto}', '{name}')" for p, proto, name in SERVICES) + ") as services(port, proto, service)"
_SERVICE_PORT = "case when dst_port < 1024 and src_port >= 1024 then dst_port when src_port < 1024 and dst_port >= 1024 then src_port else least(src_port, dst_port) end"

# ---- statistics -------------------------------------------------------------------------------

_TOTALS_SQL = """select count(*) as packets, coalesce(sum(frame_len), 0)::bigint as bytes, min(frame_len)::bigint as min_size, max(frame_len)::bigint as max_size,
  count_if(kind = 'arp')::bigint as arp, count_if(ip_version = 4)::bigint as ipv4, count_if(ip_version = 6)::bigint as ipv6, count_if(proto = 'tcp')::bigint as tcp,
  count_if(proto = 'udp')::bigint as udp, count_if(proto = 'icmp')::bigint as icmp, count_if(dst_mac = 'ff:ff:ff:ff:ff:ff')::bigint as broadcast,
  sum((not ip_checksum_ok)::int + (not l4_checksum_ok)::int)::bigint as bad_checksums,
  count_if(proto = 'tcp' and tcp_flags & 18 = 2)::bigint as syn, count_if(proto = 'tcp' and tcp_flags & 18 = 18)::bigint as syn_ack,
  count_if(proto = 'tcp' and tcp_flags & 1 = 1)::bigint as fin, count_if(proto = 'tcp' and tcp_flags & 4 = 4)::bigint as rst,
  count_if(kind = 'dns')::bigint as dns, count_if(kind = 'http')::bigint as http, count_if(kind = 'tls')::bigint as tls, count_if(truncated)::bigint as truncated,
  count_if(kind <> 'arp' and ip_version = 0)::bigint as other, coalesce(sum(frame_len) filter (kind <> 'arp' and ip_version <> 0), 0)::bigint as ip_bytes,
  count_if(dst_ip_key between '04e0' and '04f' or dst_ip_key like '06ff%')::bigint as multicast, count_if(protocol = 'DHCP')::bigint as dhcp, count_if(protocol = 'NTP')::bigint as ntp,
  0::bigint as fragments, 0::bigint as malformed, sum(payload_len)::bigint as payload_bytes, min(ts_us) as first_us, max(ts_us) as last_us from packets"""
_over_packets(
    "traffic_totals",
    stats.totals,
    f"select *, round((last_us - first_us) / 1e6, 6) as duration_s, round(packets / ((last_us - first_us) / 1e6), 6) as packets_per_s, round(bytes / ((last_us - first_us) / 1e6), 6) as bytes_per_s, round(bytes / packets, 6) as mean_size from ({_TOTALS_SQL})",
)
_BREAKDOWN = "select protocol, packets, bytes, round(100.0::double * packets / sum(packets) over (), 6) as packet_share, round(100.0::double * bytes / sum(bytes) over (), 6) as byte_share from (select protocol, count(*) as packets, sum(frame_len)::bigint as bytes from packets {where} group by protocol)"
_over_packets("protocol_breakdown", stats.protocol_breakdown, _BREAKDOWN.format(where=""))
_over_packets("filtered_breakdown", lambda p: stats.protocol_breakdown(p.where(either(field("udp.port") == 53, field("tcp.flags.syn").exists()))), _BREAKDOWN.format(where="where (proto = 'udp' and (src_port = 53 or dst_port = 53)) or (proto = 'tcp' and tcp_flags & 2 = 2)"))
_SIDES = "select number, frame_len as size, src_ip as ip, true as sent, src_mac as mac from packets where src_ip is not null union all select number, frame_len, dst_ip, false, dst_mac from packets where dst_ip is not null"
_ENDPOINTS = f"select ip, count_if(sent)::bigint as tx_packets, coalesce(sum(size) filter (sent), 0)::bigint as tx_bytes, count_if(not sent)::bigint as rx_packets, coalesce(sum(size) filter (not sent), 0)::bigint as rx_bytes, coalesce(arg_max(mac, number) filter (sent), arg_min(mac, number) filter (not sent)) as mac from ({_SIDES}) group by ip"
_over_packets("endpoints", stats.endpoints, _ENDPOINTS)
_over_packets("top_talkers", stats.top_talkers, f"select * from ({_ENDPOINTS}) order by tx_bytes + rx_bytes desc, tx_packets + rx_packets desc, ip limit 10")
_SIDED = "select *, dst_ip_key < src_ip_key as swap from packets where src_ip is not null"
_CONVERSATIONS = f"""select case when swap then dst_ip else src_ip end as a_ip, case when swap then dst_port else src_port end as a_port, case when swap then src_ip else dst_ip end as b_ip, case when swap then src_port else dst_port end as b_port, proto,
  count(*) as packets, sum(frame_len)::bigint as bytes, coalesce(sum(frame_len) filter (not swap), 0)::bigint as a_to_b_bytes, coalesce(sum(frame_len) filter (swap), 0)::bigint as b_to_a_bytes, min(ts_us) as first_us, max(ts_us) as last_us,
  case when length(arg_max(protocol, length(protocol) * 1000000000000 - number) filter (protocol not in ('TCP', 'UDP', 'IPv4', 'IPv6'))) > length(arg_min(protocol, number)) then arg_max(protocol, length(protocol) * 1000000000000 - number) filter (protocol not in ('TCP', 'UDP', 'IPv4', 'IPv6')) else arg_min(protocol, number) end as application
  from ({_SIDED}) group by 1, 2, 3, 4, 5"""
_over_packets("conversations", stats.conversations, _CONVERSATIONS)
_over_packets("top_conversations", stats.top_conversations, f"select * from ({_CONVERSATIONS}) order by bytes desc, packets desc, a_ip, a_port, b_ip, b_port, proto limit 10")
for _proto in ("tcp", "udp"):
    _PORTS = f"select p.port, p.packets, p.bytes, coalesce(s.service, 'unknown') as service from (select {_SERVICE_PORT} as port, count(*) as packets, sum(frame_len)::bigint as bytes from packets where proto = '{_proto}' group by 1) p left join {_SERVICES_SQL} on s.port = p.port and s.proto = '{_proto}' where p.port > 0"
    _over_packets(f"top_ports_{_proto}", lambda p, proto=_proto: stats.top_ports(p, proto), _PORTS.replace("as services(", "as s(") + " order by packets desc, bytes desc, p.port limit 10")
_over_packets(
    "size_histogram",
    stats.size_histogram,
    "select b.bucket, b.label, count(p.frame_len) as packets from (values (0, '0-63', 0, 64), (1, '64-127', 64, 128), (2, '128-255', 128, 256), (3, '256-511', 256, 512), (4, '512-1023', 512, 1024), (5, '1024-1519', 1024, 1520), (6, '1520+', 1520, 1000000)) as b(bucket, label, lo, hi) left join packets p on p.frame_len >= b.lo and p.frame_len < b.hi group by 1, 2",
)
for _ms in (1000, 10_000, 3_600_000):
    _SERIES = f"select f.first_ms + ((p.ms - f.first_ms) // {_ms}) * {_ms} as start_ms, count(*) as packets, sum(frame_len)::bigint as bytes from (select (ts_us // 100000) * 100 as ms, frame_len from packets) p, (select min((ts_us // 100000) * 100) as first_ms from packets) f group by 1"
    _over_packets(f"time_series_{_ms // 1000}s", lambda p, ms=_ms: stats.time_series(p, ms), f"select *, round(bytes::double * 8 * 1000 / {_ms}, 6) as bits_per_s from ({_SERIES})")
_over_packets(
    "retransmissions",
    stats.retransmissions,
    "select number, src_ip, src_port, dst_ip, dst_port, seq, payload_len from (select *, max(ending) over (partition by src_ip, src_port, dst_ip, dst_port order by number rows between unbounded preceding and 1 preceding) as before from (select *, case when payload_len > 0 then (seq + payload_len) % 4294967296 end as ending from packets where proto = 'tcp')) where ending <= before",
)
_over_packets("run_summary", lambda p: stats.run_summary(p, field("ip.addr") == "10.0.0.0/28"), "select count(*) as packets, count_if(hit)::bigint as matched, count_if(not hit)::bigint as filtered_out, sum(frame_len)::bigint as bytes, coalesce(sum(frame_len) filter (hit), 0)::bigint as matched_bytes, count_if(truncated)::bigint as truncated, null::bigint as decode_errors from (select *, coalesce(src_ip_key between '040a000000' and '040a00000f', false) or coalesce(dst_ip_key between '040a000000' and '040a00000f', false) as hit from packets)")
_over_packets("captures_union", lambda p: stats.protocol_breakdown(stats.merge(p.where("number % 3 = 0"), p.where("number % 3 > 0"))), _BREAKDOWN.format(where=""))
_over_packets("tcp_flag_text", lambda p: p.where("proto = 'tcp'").groupBy(P.flags_text().alias("flags")).agg(F.count(F.lit(1)).alias("packets")), "select case tcp_flags when 0 then 'none' when 2 then 'SYN' when 18 then 'SYN,ACK' when 16 then 'ACK' when 24 then 'PSH,ACK' when 17 then 'FIN,ACK' when 4 then 'RST' end as flags, count(*) as packets from packets where proto = 'tcp' group by 1")

# ---- flows ------------------------------------------------------------------------------------

_KEYED = """select *, fdst_key < fsrc_key as swap from (select * replace (case when proto in ('tcp', 'udp') then src_port else 0 end as src_port, case when proto in ('tcp', 'udp') then dst_port else 0 end as dst_port),
  coalesce(src_ip, arp_sender_ip) as fsrc, coalesce(dst_ip, arp_target_ip) as fdst, coalesce(src_ip_key, arp_sender_key) as fsrc_key, coalesce(dst_ip_key, arp_target_key) as fdst_key from packets)"""
_MARKED = f"select *, coalesce(ending <= max(ending) over (partition by fsrc, src_port, fdst, dst_port, proto order by number rows between unbounded preceding and 1 preceding), false) as again from (select *, case when payload_len > 0 then (seq + payload_len) % 4294967296 end as ending from ({_KEYED}))"
_FLOWS = f"""select *, greatest(0, last_us - first_us) as duration_us from (select case when swap then fdst else fsrc end as a_ip, case when swap then dst_port else src_port end as a_port, case when swap then fsrc else fdst end as b_ip, case when swap then src_port else dst_port end as b_port, proto,
  count(*) as packets, sum(frame_len)::bigint as bytes, count_if(not swap)::bigint as packets_forward, count_if(swap)::bigint as packets_backward, coalesce(sum(frame_len) filter (not swap), 0)::bigint as bytes_forward, coalesce(sum(frame_len) filter (swap), 0)::bigint as bytes_backward,
  sum(payload_len)::bigint as payload_bytes, min(ts_us) as first_us, max(ts_us) as last_us, count_if(again and proto = 'tcp')::bigint as retransmissions,
  coalesce(arg_max(protocol, number) filter (protocol in ('HTTP', 'DNS') or protocol like 'TLS%'), arg_min(protocol, number)) as application,
  arg_max(ttl, number) filter (ttl > 0) as last_ttl, arg_max(tcp_window, number) filter (proto = 'tcp') as last_window, arg_max(src_mac, number) filter (not swap) as a_mac, arg_max(src_mac, number) filter (swap) as b_mac,
  arg_max(dns_qname, number) filter (dns_qname is not null) as dns_name, arg_max(http_host, number) filter (http_host <> '') as http_host, arg_max(http_uri, number) filter (http_uri <> '') as http_uri, arg_max(http_status, number) filter (http_status > 0) as http_status, arg_max(tls_sni, number) filter (tls_sni <> '') as tls_sni,
  case when proto = 'udp' then 'established' when proto <> 'tcp' then 'unknown'
    when arg_max(tcp_flags & 4, number) filter (tcp_flags & 5 > 0) = 4 then 'reset'
    when count_if(tcp_flags & 5 > 0) > 0 then case when count_if(tcp_flags & 7 = 1 and not swap) > 0 and count_if(tcp_flags & 7 = 1 and swap) > 0 then 'closed' else 'fin-wait' end
    when count_if(tcp_flags & 18 = 16) > 0 then 'established' when count_if(tcp_flags & 18 = 18) > 0 then 'syn-received' when count_if(tcp_flags & 2 = 2) > 0 then 'syn-sent' else 'new' end as state
  from ({_MARKED}) group by 1, 2, 3, 4, 5)"""
_KEYS = "a_ip, a_port, b_ip, b_port, proto"
_over_packets("flow_table", W.flows, _FLOWS)
_over_packets("flow_states", lambda p: W.flows(p).groupBy("proto", "state").agg(F.count(F.lit(1)).alias("flows")), f"select proto, state, count(*) as flows from ({_FLOWS}) group by 1, 2")
_over_packets("flow_summary", lambda p: W.summary(W.flows(p)), f"select count(*) as flows, count_if(proto = 'tcp')::bigint as tcp, count_if(proto = 'udp')::bigint as udp, count_if(proto not in ('tcp', 'udp'))::bigint as other, count_if(state = 'established')::bigint as established, count_if(state in ('closed', 'reset'))::bigint as closed, count_if(state not in ('closed', 'reset'))::bigint as active, sum(packets)::bigint as packets, sum(bytes)::bigint as bytes, sum(retransmissions)::bigint as retransmissions, max(duration_us) as longest_us from ({_FLOWS})")
for _sort, _order in (("last", "last_us desc"), ("first", "first_us"), ("bytes", "bytes desc"), ("packets", "packets desc"), ("duration", "duration_us desc")):
    _over_packets(f"flows_by_{_sort}", lambda p, s=_sort: W.listed(W.flows(p), s, 25), f"select * from ({_FLOWS}) order by {_order}, {_KEYS} limit 25")
_over_packets("flows_active", lambda p: W.active(W.flows(p), 50), f"select * from ({_FLOWS}) where state not in ('closed', 'reset') order by last_us desc, {_KEYS} limit 50")
_over_packets("flows_for_address", lambda p: W.for_address(W.flows(p), "10.0.0.5"), f"select * from ({_FLOWS}) where a_ip = '10.0.0.5' or b_ip = '10.0.0.5'")
_over_packets("flows_for_port", lambda p: W.for_port(W.flows(p), 443, 40), f"select * from ({_FLOWS}) where a_port = 443 or b_port = 443 order by bytes desc, {_KEYS} limit 40")
_over_packets("flows_for_app", lambda p: W.for_application(W.flows(p), "http", 40), f"select * from ({_FLOWS}) where lower(application) = 'http' order by bytes desc, {_KEYS} limit 40")
_over_packets("flows_unexpired", lambda p: W.unexpired(W.flows(p), p), f"select * from ({_FLOWS}) where (select max(ts_us) from packets) - last_us <= case when proto = 'tcp' then 300000000 else 120000000 end")
_over_packets("flow_key", lambda p: p.where("src_ip is not null").groupBy(P.flow_key_text().alias("flow")).agg(F.count(F.lit(1)).alias("packets")), "select proto || '|' || case when src_ip_key < dst_ip_key or (src_ip_key = dst_ip_key and src_port <= dst_port) then src_ip || ':' || src_port || '|' || dst_ip || ':' || dst_port else dst_ip || ':' || dst_port || '|' || src_ip || ':' || src_port end as flow, count(*) as packets from packets where src_ip is not null group by 1")

# ---- filters ----------------------------------------------------------------------------------


def _filter(name: str, condition: Callable[[], Column], where: str) -> None:
    _over_packets(f"filter_{name}", lambda p: p.where(condition()).select("number", "protocol", "frame_len"), f"select number, protocol, frame_len from packets where {where}")


_filter("eq", lambda: field("tcp.dstport") == 443, "proto = 'tcp' and dst_port = 443")
_filter("ne", lambda: field("ip.dst") != "10.0.0.5", "dst_ip_key is not null and dst_ip_key <> '040a000005'")
_filter("lt", lambda: field("frame.len") < 100, "frame_len < 100")
_filter("ge", lambda: field("ip.ttl") >= 128, "ttl >= 128")
_filter("contains", lambda: field("dns.qry.name").contains("t1"), "contains(dns_qname, 't1')")
_filter("matches", lambda: field("http.host").matches(r"(?i)^WWW[12]\."), "regexp_matches(http_host, '(?i)^WWW[12]\\.')")
_filter("in", lambda: field("ip.src").isin("10.0.0.0/28", "192.168.1.0/24", "2001:db8::5"), "src_ip_key between '040a000000' and '040a00000f' or src_ip_key between '04c0a80100' and '04c0a801ff' or src_ip = '2001:db8::5'")
_filter("cidr", lambda: field("ip.addr") == "2001:db8::/32", "src_ip_key like '0620010db8%' or dst_ip_key like '0620010db8%'")
_filter("not", lambda: negate(field("http.request.method") == "GET"), "coalesce(http_method, '') <> 'GET'")
_filter("exists", lambda: field("http.host").exists(), "http_host is not null")
_filter("anyof", lambda: field("tcp.port") == 80, "proto = 'tcp' and (src_port = 80 or dst_port = 80)")
_filter("anyof_ne", lambda: field("tcp.port") != 80, "proto = 'tcp' and src_port <> 80 and dst_port <> 80")
_filter("flags", lambda: both(field("tcp.flags.syn").exists(), negate(field("tcp.flags.ack").exists())), "proto = 'tcp' and tcp_flags & 18 = 2")
_filter("mac", lambda: field("eth.addr") == "FF-FF-FF-FF-FF-FF", "src_mac = 'ff:ff:ff:ff:ff:ff' or dst_mac = 'ff:ff:ff:ff:ff:ff'")
_filter("ip_text", lambda: field("ip.src").matches(r"^10\.0\.0\.1\d$"), "regexp_matches(src_ip, '^10\\.0\\.0\\.1\\d$')")
_filter("number_text", lambda: field("port").contains("400"), "proto in ('tcp', 'udp') and (contains(src_port::varchar, '400') or contains(dst_port::varchar, '400'))")
_filter("precedence", lambda: either(field("dns").exists(), both(field("tcp").exists(), field("frame.len") > 200)), "kind = 'dns' or (proto = 'tcp' and frame_len > 200)")
_filter("empty_set", lambda: total(field("ip.src").isin()), "false")
_add("filter_counts", lambda s, d: packets(s, d).agg(*[F.count_if(total(c)).alias(n) for n, c in (("dns_or_http", either(field("dns").exists(), field("http").exists())), ("handshakes", field("tcp.handshake").exists()), ("long", field("payload.len") > 300), ("bad", field("ip.checksum_bad").exists()))]), " select count_if(kind in ('dns', 'http'))::bigint as dns_or_http, count_if(proto = 'tcp' and tcp_flags & 6 > 0)::bigint as handshakes, count_if(payload_len > 300)::bigint as long, count_if(not ip_checksum_ok)::bigint as bad from packets")

# ---- rings ------------------------------------------------------------------------------------

_over_packets("ring_snapshot", lambda p: ring.snapshot(p, 4096, 20).select("number", "protocol"), "select number, protocol from packets order by number desc limit 20")
_over_packets("ring_since", lambda p: ring.since(p, 4096, 100, 30).select("number", "protocol"), "select number, protocol from (select * from packets where number > 100 order by number desc limit 30)")
_over_packets("ring_state", lambda p: ring.state(p, 300), "select least(count(*), 300) as size, count(*) as pushed, greatest(count(*) - 300, 0) as dropped, greatest(max(number) - 299, min(number)) as oldest, max(number) as newest from packets")
_over_packets("first_matched", lambda p: ring.first_matched(p, field("http").exists(), 25).select("number", "protocol"), "select number, protocol from packets where kind = 'http' order by number limit 25")

# ---- scalar functions -------------------------------------------------------------------------

_over_packets("ip_classes", lambda p: p.where("src_ip is not null").groupBy(IP.ip_class(F.col("dst_ip_key")).alias("class"), "ip_version").agg(F.count(F.lit(1)).alias("packets")), "select case when ip_version = 6 then 'public' else 'private' end as class, ip_version, count(*) as packets from packets where src_ip is not null group by 1, 2")
_over_packets(
    "ipv4_parts",
    lambda p: p.where("ip_version = 4").select("number", IP.ipv4_key(F.col("src_ip")).alias("key"), IP.ipv4_text(F.col("src_ip_key")).alias("text"), IP.ipv4_text(IP.ipv4_network(F.col("src_ip_key"), F.lit(24))).alias("network"), IP.host_count(F.lit(24)).alias("hosts")),
    "select number, src_ip_key as key, src_ip as text, regexp_replace(src_ip, '\\.\\d+$', '.0') as network, 254::bigint as hosts from packets where ip_version = 4",
)
_over_packets("mac_flags", lambda p: p.select("number", *[c.alias(n) for n, c in IP.mac_flags(F.col("dst_mac")).items()]), "select number, dst_mac = 'ff:ff:ff:ff:ff:ff' as multicast, dst_mac = 'ff:ff:ff:ff:ff:ff' or dst_mac like '02:%' as local, false as zero, dst_mac = 'ff:ff:ff:ff:ff:ff' as broadcast from packets")
_over_packets("mac_vendors", lambda p: vendor_name(p.select(F.col("src_mac").alias("mac"))).groupBy("vendor").agg(F.count(F.lit(1)).alias("packets")), "select case when src_mac like '00:50:56%' then 'VMware' end as vendor, count(*) as packets from packets group by 1")
_over_packets("service_ports", lambda p: p.where("proto in ('tcp', 'udp')").groupBy("proto", P.interesting_port().alias("port")).agg(F.count(F.lit(1)).alias("packets")), f"select proto, {_SERVICE_PORT} as port, count(*) as packets from packets where proto in ('tcp', 'udp') group by 1, 2")
_over_packets("endpoint_text", lambda p: p.select("number", P.source_text().alias("source")), "select number, case when src_ip is null then src_mac when src_port > 0 then src_ip || ':' || src_port else src_ip end as source from packets")
_over_packets("url_decode", lambda p: p.where("http_uri <> ''").select("number", X.url_path(F.col("http_uri")).alias("path"), X.query_value(F.col("http_uri"), "q").alias("q")), "select number, split_part(http_uri, '?', 1) as path, replace(url_decode(replace(regexp_extract(http_uri, '[?&]q=([^&]*)', 1), '+', ' ')), '', '') as q from packets where http_uri <> ''")
_over_packets("human_bytes", lambda p: p.groupBy("protocol").agg(F.sum(F.col("frame_len").cast("long")).alias("bytes")).select("protocol", X.human_bytes(F.col("bytes")).alias("text")), "select protocol, case when bytes < 1024 then bytes || ' B' when bytes < 1048576 then printf('%.2f KB', bytes / 1024.0) when bytes < 1073741824 then printf('%.2f MB', bytes / 1048576.0) else printf('%.2f GB', bytes / 1073741824.0) end as text from (select protocol, sum(frame_len)::bigint as bytes from packets group by 1)")
_over_packets("port_compaction", lambda p: X.compact_ports(p.where("src_port > 0").select("proto", F.col("src_port").alias("port")), ["proto"]), "select proto, string_agg(case when lo = hi then lo::varchar else lo || '-' || hi end, ',' order by lo) as ports from (select proto, min(port) as lo, max(port) as hi from (select proto, port, port - row_number() over (partition by proto order by port) as island from (select distinct proto, src_port as port from packets where src_port > 0)) group by proto, island) group by proto")
_OS_CASES = {"t": "case number % 6 when 0 then 0 when 1 then 20 when 2 then 64 when 3 then 128 when 4 then 200 else 255 end", "w": "case number % 8 when 0 then 8192 when 1 then 16384 when 2 then 65535 when 3 then 5840 when 4 then 14600 when 5 then 64240 when 6 then 4128 else 1000 end", "df": "number % 5 < 2"}
_over_packets(
    "os_guess",
    lambda p: p.select("number", *[F.expr(e).alias(n) for n, e in _OS_CASES.items()]).select("number", scans.os_guess(F.col("t"), F.col("w"), F.col("df")).alias("os")),
    """select number, case when t = 0 then 'unknown' when t = 255 and df then 'Network device (router/switch/firewall)'
  when w = 8192 then 'Windows XP/2003' when w = 16384 then 'Windows Vista/7/2008' when w = 65535 then 'macOS/BSD or older Windows' when w = 5840 then 'Linux 2.6+'
  when w = 14600 then 'Linux 3.x+/4.x+' when w = 64240 then 'Linux 5.x+ or Windows 10+' when w = 4128 then 'Cisco IOS'
  when t <= 32 then 'Windows (TTL <= 32)' when t <= 64 then 'Linux/Unix/macOS (TTL <= 64)' when t <= 128 then 'Windows (TTL <= 128)' else 'Network device / Solaris (TTL > 128)' end as os
  from (select number, """ + ", ".join(f"{e} as {n}" for n, e in _OS_CASES.items()) + " from packets)",
)

# ---- scan observations, drawn from the same packets -------------------------------------------

_PROBES = "select 'scan-1' as scan_id, dst_ip as address, dst_port as port, proto, case when tcp_flags & 18 = 18 or proto = 'udp' then 'open' when tcp_flags & 4 = 4 then 'closed' when tcp_flags & 16 = 16 then 'unfiltered' else 'filtered' end as state, case when kind = 'http' and http_method is not null then 'Server: nginx/1.18.' || (number % 3) else '' end as banner, ttl, tcp_window, number as seq, number % 900 as rtt_us from packets where proto in ('tcp', 'udp')"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).where("proto in ('tcp', 'udp')")
    state = F.when(P.is_syn_ack() | (F.col("proto") == "udp"), "open").when(P.flag(P.RST), "closed").when(P.flag(P.ACK), "unfiltered").otherwise("filtered")
    banner = F.when((F.col("kind") == "http") & F.col("http_method").isNotNull(), F.concat(F.lit("Server: nginx/1.18."), (F.col("number") % 3).cast("string"))).otherwise("")
    return p.select(F.lit("scan-1").alias("scan_id"), F.col("dst_ip").alias("address"), F.col("dst_port").alias("port"), "proto", state.alias("state"), banner.alias("banner"), "ttl", "tcp_window", F.col("number").alias("seq"), (F.col("number") % 900).alias("rtt_us"))


_PORT_ROWS = f"select scan_id, address, proto, port, case when count_if(state = 'open') > 0 then 'open' else arg_min(state, seq) end as state, coalesce(arg_min(banner, seq) filter (banner <> '' and state = 'open'), arg_min(banner, seq) filter (banner <> ''), '') as banner, count(*) as probes from ({_PROBES}) group by 1, 2, 3, 4"
_HOST_ROWS = f"select scan_id, address, count(*) > 0 as up, arg_min(rtt_us, seq) as latency_us, arg_min(ttl, seq) filter (ttl > 0) as ttl, arg_min(tcp_window, seq) filter (tcp_window > 0) as tcp_window from ({_PROBES}) group by 1, 2"
_add("scan_finalize", lambda s, d: scans.port_results(_probes(s, d)), " " + _PORT_ROWS)
_add("scan_hosts", lambda s, d: scans.host_results(_probes(s, d)), " " + _HOST_ROWS)
_add("scan_counts", lambda s, d: scans.counts(scans.port_results(_probes(s, d))), f" select count(distinct address) filter (state = 'open') as hosts_with_open_ports, count_if(state = 'open')::bigint as open, count_if(state = 'closed')::bigint as closed, count_if(state in ('filtered', 'open|filtered'))::bigint as filtered from ({_PORT_ROWS})")
_add("open_port_histogram", lambda s, d: scans.open_port_histogram(scans.port_results(_probes(s, d))), f" select port, count(distinct address) as hosts from ({_PORT_ROWS}) where state = 'open' group by 1")
_add("service_match", lambda s, d: signatures.match_services(scans.port_results(_probes(s, d)).where("banner <> ''")), f" select scan_id, address, proto, port, 'http' as service, substr(banner, 9) as product, '' as version, '' as extra, 6 as confidence from ({_PORT_ROWS}) where banner <> ''")
_add("scan_inventory", lambda s, d: scans.inventory(scans.port_results(_probes(s, d))), f" select address, string_agg(port || '/' || proto, ',' order by port, proto) as open_ports from ({_PORT_ROWS}) where state = 'open' group by 1")
_add("targets_expand", lambda s, d: scans.without(scans.expand_targets(s, "10.0.0.0/24,10.0.1.5-10.0.1.20,192.168.7.1,10.0.0.7", 4096), s, "10.0.0.128/25,192.168.7.1").select("address"), "select '10.0.0.' || i as address from range(0, 128) t(i) union all select '10.0.1.' || i from range(5, 21) t(i)", "")
_add("probe_plan", lambda s, d: scans.probe_plan(scans.expand_targets(s, "10.0.0.0/28", 4096), scans.expand_ports(s, "22,80,8000-8002")), "select '10.0.0.' || i as address, p as port from range(0, 16) t(i), (values (22), (80), (8000), (8001), (8002)) as ports(p)", "")

# ---- store reports ----------------------------------------------------------------------------

_add("store_recent", lambda s, d: store.recent(_captures(s, d), "first_us", 5, "capture_id"), " select * from (select 'c' || (number % 9) as capture_id, count(*) as packets, min(ts_us) as first_us from packets group by 1) order by first_us desc, capture_id limit 5")
_add("store_host_search", lambda s, d: store.search(_probes(s, d).select("address").distinct(), ["address"], "0.0.1", "address"), f" select distinct address from ({_PROBES}) where address ilike '%0.0.1%'")
_add("store_counts", lambda s, d: store.counts({"captures": _captures(s, d), "flows": W.flows(packets(s, d)), "packets": packets(s, d)}), f" select 'captures' as name, count(distinct number % 9) as rows from packets union all select 'flows', count(*) from ({_FLOWS}) union all select 'packets', count(*) from packets")
_add("scan_detail", lambda s, d: store.detail(scans.host_results(_probes(s, d)), scans.port_results(_probes(s, d))), f" select h.address, h.ttl, count_if(p.state = 'open')::bigint as open, count(*) as ports from ({_HOST_ROWS}) h join ({_PORT_ROWS}) p on h.scan_id = p.scan_id and h.address = p.address group by 1, 2")


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir)
    return p.groupBy(F.concat(F.lit("c"), (F.col("number") % 9).cast("string")).alias("capture_id")).agg(F.count(F.lit(1)).alias("packets"), F.min("ts_us").alias("first_us"))



#: A banner for every signature (port, banner) and what it tells (service, product, version, extra, confidence).
BANNERS: tuple[tuple[int, str, str, str, str, str, int], ...] = (
    (22, "SSH-2.0-OpenSSH_8.9p1 Ubuntu", "ssh", "OpenSSH", "8.9p1", "", 9), (22, "SSH-2.0-Dropbear_2020.81", "ssh", "Dropbear SSH", "2020.81", "", 9), (22, "SSH-2.0-libssh-0.9", "ssh", "libssh-0.9", "", "SSH banner", 7),
    (80, "HTTP/1.1 404 Not Found", "http", "", "", "HTTP 1.1 response, status 404", 7), (80, "server: Caddy 2", "http", "Caddy 2", "", "", 6), (554, "RTSP/1.0 200 OK", "rtsp", "", "200", "RTSP status 200", 7), (5060, "SIP/2.0 486 Busy", "sip", "", "486", "SIP status 486", 7),
    (21, "220 my FTP", "ftp", "", "", "", 7), (21, "220 (vsFTPd 3.0.3)", "ftp", "vsftpd", "3.0.3", "", 9), (21, "220 proftpd 1.3.5e Server", "ftp", "ProFTPD", "1.3.5e", "", 8), (21, "220---- Pure-FTPd ----", "ftp", "Pure-FTPd", "", "", 8), (21, "220-FileZilla Server 0.9.60 beta", "ftp", "FileZilla Server", "0.9.60", "", 8),
    (25, "220 mx ESMTP ready", "smtp", "", "", "", 7), (25, "220 mx ESMTP exim 4", "smtp", "exim", "", "", 8), (110, "220 mail POP3", "pop3", "", "", "", 7), (110, "+OK Dovecot ready.", "pop3", "Dovecot", "", "", 8), (143, "* OK IMAP4rev1", "imap", "", "", "", 7), (143, "* OK Dovecot", "imap", "Dovecot", "", "", 8), (143, "* OK Cyrus v2", "imap", "", "", "", 8),
    (119, "220 NNTP here", "nntp", "", "", "", 7), (3306, "mysql native", "mysql", "MySQL", "", "", 8), (3306, "x 10.5.2-MariaDB", "mysql", "MariaDB", "10.5.2", "", 9), (5432, "postgresql 14.2 on", "postgresql", "PostgreSQL", "14.2", "", 9), (6379, "-ERR unknown command", "redis", "Redis", "", "", 7), (6379, "+PONG", "redis", "Redis", "", "", 9),
    (11211, "VERSION 1.6.9\r\n", "memcached", "Memcached", "1.6.9", "", 9), (11211, "STAT pid 7\r\n", "memcached", "Memcached", "", "", 7), (5672, "AMQP0", "amqp", "RabbitMQ", "", "AMQP protocol header", 7), (1883, "\x10abMQTT", "mqtt", "MQTT broker", "", "", 7), (9200, '{"cluster_name" : "es1"}', "http", "Elasticsearch", "", "cluster es1", 9),
    (445, "\xffSMBr", "microsoft-ds", "Samba or Windows SMB", "", "SMB dialect negotiation", 7), (5900, "RFB 003.008", "vnc", "RFB", "003.008", "", 8), (3389, "\x03\x00\x00\x0b", "ms-wbt-server", "Microsoft Terminal Services", "", "RDP negotiation", 7), (23, "\xff\xfd\x18", "telnet", "", "", "telnet option negotiation", 7), (873, "@RSYNCD: 31.0", "rsync", "rsyncd", "31.0", "", 9),
    (873, "220 RSYNC x", "rsync", "rsyncd", "", "", 7), (27017, "Connected to my MongoDB 4", "mongodb", "MongoDB", "", "my MongoDB", 8), (1, '{"jsonrpc":"2.0"}', "jsonrpc", "", "", "JSON-RPC response", 6), (1, "<HTML>", "http", "", "", "HTML response", 5), (389, "ldap_bind failed", "ldap", "", "", "LDAP response", 6), (137, "NetBIOS name", "netbios-ssn", "", "", "", 6),
    (1900, "HTTP/1.1 200 OK\r\nA: b\r\nST: upnp:root", "http", "", "", "HTTP 1.1 response, status 200", 7), (1900, "NOTIFY upnp", "", "", "", "", 0), (123, "NTP v4 stratum 2", "ntp", "", "", "", 5), (161, "SNMPv2-MIB", "snmp", "", "", "", 6), (9, "nothing known", "", "", "", "", 0),
)


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packet's number picks a banner, so each signature meets its own."""
    n = F.lit(len(BANNERS)).cast("long")
    pick = lambda k: F.get(F.array(*[F.lit(b[k]) for b in BANNERS]), (F.col("number") % n).cast("int"))
    p = packets(spark, sf_dir).select("number", pick(0).alias("port"), pick(1).alias("banner"))
    m = p.select("number", signatures.match_banner(F.col("banner"), F.col("port")).alias("m"))
    return m.where("m is not null").select("number", "m.service", "m.product", "m.version", "m.extra", "m.confidence")


_KNOWN = ", ".join(f"({i}, '{s}', '{p}', '{v}', '{e}', {c})" for i, (_, _, s, p, v, e, c) in enumerate(BANNERS) if s)
QUERIES["service_signatures"] = _told
ORACLES["service_signatures"] = f"{PACKETS_CTE} select number, service, product, version, extra, confidence from packets join (values {_KNOWN}) t(i, service, product, version, extra, confidence) on number % {len(BANNERS)} = i"
