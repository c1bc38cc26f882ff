"""Queries of reports, scan finalisation, names and host tables, each with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.decode.frames import decode
from tidewire.filters.fields import logical as field
from tidewire.functions import names as N
from tidewire.functions.lookups import SERVICES
from tidewire.operators import flows as W
from tidewire.operators import reports, scans, stats, store
from tidewire.plans.bridge import PACKETS_CTE, packets
from tidewire.plans.catalog import _FLOWS, _MARKED, _probes, _PROBES
from tidewire.plans.frames import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(packets(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = f"{PACKETS_CTE} {sql}"


def _pad(text: str, width: int, right: bool = False) -> str:
    blanks = f"repeat(' ', greatest(0, {width} - length({text})))"
    return f"{blanks} || {text}" if right else f"{text} || {blanks}"


def _cut(text: str, width: int) -> str:
    return f"case when length({text}) > {width} then substr({text}, 1, {width - 1}) || '…' else {text} end"


# ---- info and lines ---------------------------------------------------------------------------

_FLAGS = "case tcp_flags when 0 then 'none' when 2 then 'SYN' when 18 then 'SYN,ACK' when 16 then 'ACK' when 24 then 'PSH,ACK' when 17 then 'FIN,ACK' when 4 then 'RST' end"
_APPLICATION = """case when coalesce(http_method, '') <> '' then http_method || ' ' || http_uri when http_status > 0 then 'HTTP/1.1 ' || http_status || ' ' || http_reason
  when dns_response then 'response ' || dns_qname || ' (' || dns_rcode || ')' when kind = 'dns' then dns_type || '? ' || dns_qname else summary end"""
_ICMP = """case icmp_type when 128 then 'ICMPv6 echo request' when 129 then 'ICMPv6 echo reply' when 8 then 'Echo request (ping)' when 0 then 'Echo reply (ping)'
  else case icmp_code when 0 then 'Destination network unreachable' when 1 then 'Destination host unreachable' else 'Destination unreachable' end end"""


def _info_sql(echo: str = "''", opened: str = "''") -> str:
    """The line of a packet; frames also carry the numbers of an echo and the segment size of a connection that opens."""
    return f"""(case when arp_opcode = 1 then 'Who has ' || arp_target_ip || '? Tell ' || arp_sender_ip when arp_opcode = 2 then arp_sender_ip || ' is at ' || src_mac when proto = 'icmp' then {_ICMP} || {echo} || ' len=' || payload_len
  when summary is not null then summary
  when proto = 'tcp' then src_port || ' → ' || dst_port || ' [' || {_FLAGS} || '] Seq=' || seq || ' Ack=' || ack || ' Win=' || tcp_window || ' Len=' || payload_len || {opened} || case when l4_checksum_ok then '' else ' [checksum invalid]' end
  else src_port || ' → ' || dst_port || ' Len=' || payload_len end || case when truncated then ' [truncated]' else '' end)"""


_INFO = _info_sql()
_ECHO = "case when icmp_type = 3 then '' else ' id=0x' || lower(printf('%04x', number % 65536)) || ' seq=1' end"
_add("packet_info", lambda p: p.select("number", reports.packet_info(p).alias("info")), f"select number, {_INFO} as info from packets")


# the same from bytes: the decoder's lines against columns that were never bytes
QUERIES["decode_info"] = lambda spark, sf_dir: decode(frames(spark, sf_dir)).select("number", "protocol", "info")
ORACLES["decode_info"] = f"{PACKETS_CTE} select number, case when kind = 'tls' then 'TLSv1.2' when kind = 'icmp' and ip_version = 6 then 'ICMPv6' else protocol end as protocol, {_info_sql(_ECHO, "case when tcp_flags = 2 then ' MSS=1460' else '' end")} as info from packets"


def _end(side: str) -> str:
    return f"(case when {side}_ip is null then {side}_mac when {side}_port > 0 then {side}_ip || ':' || {side}_port else {side}_ip end)"


_LINE = f"""select number, {_pad("number::varchar", 7, True)} || {_pad("strftime(make_timestamp(ts_us), '%H:%M:%S.%f')", 17)} || {_pad("a", 24)} || {_pad("b", 24)} || {_pad("protocol", 8)} || {_pad("frame_len::varchar", 7, True)} || info as line
  from (select *, {_cut(_end("src"), 22)} as a, {_cut(_end("dst"), 22)} as b, {_INFO} as info from packets)"""
_add("packet_lines", reports.packet_lines, _LINE)

_DETAILED = f"""(select *, coalesce(strong, case when reset_first then 'connection reset' end, weak) as info from (select case when swap then fdst else fsrc end as a_ip, case when swap then dst_port else src_port end as a_port,
  case when swap then fsrc else fdst end as b_ip, case when swap then src_port else dst_port end as b_port, proto, arg_max({_APPLICATION}, number) filter (({_APPLICATION}) is not null) as strong, arg_min({_INFO}, number) as weak,
  arg_min(proto = 'tcp' and tcp_flags & 4 = 4, number) as reset_first, arg_max(http_method, number) filter (http_method <> '') as http_method, count_if(proto = 'tcp' and tcp_flags & 5 > 0) > 0 as completed
  from ({_MARKED}) group by 1, 2, 3, 4, 5))"""
_KEYS = "a_ip, a_port, b_ip, b_port, proto"
_add("flow_info", lambda p: reports.detailed_flows(p).select(*W.KEY, "info", "http_method", "completed", "retransmissions"), f"select {_KEYS}, info, http_method, completed, retransmissions from {_DETAILED} join ({_FLOWS}) using ({_KEYS})")
_flow_end = lambda s: f"case when {s}_port > 0 then {s}_ip || ':' || {s}_port else {s}_ip end"
_add(
    "flow_lines",
    lambda p: reports.flow_lines(reports.detailed_flows(p), 100, "bytes"),
    f"""select {_KEYS}, {_pad("upper(proto)", 7)} || {_pad("a", 32)} || {_pad("b", 32)} || {_pad("packets::varchar", 9, True)} || {_pad("bytes::varchar", 12, True)} || ' ' || {_pad("state", 13)} || {_pad("app", 16)} || {_cut("info", 48)} as line
  from (select *, {_cut("(" + _flow_end("a") + ")", 30)} as a, {_cut("(" + _flow_end("b") + ")", 30)} as b, {_cut("application", 14)} as app from {_DETAILED} join ({_FLOWS}) using ({_KEYS})) order by bytes desc, {_KEYS} limit 100""",
)


def _json(pairs: list[tuple[str, str, str]]) -> str:
    """A JSON object of (key, value, kind): text, number, or raw; NULL values are left out."""
    parts = []
    for key, value, kind in pairs:
        shown = f"'\"' || replace({value}, '\"', '\\\"') || '\"'" if kind == "text" else f"({value})::varchar"
        parts.append(f"'\"{key}\":' || {shown}")
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


_texts = lambda *pairs: [(k, v, "text") for k, v in pairs]
_numbers = lambda *pairs: [(k, v, "number") for k, v in pairs]
_add(
    "flow_json",
    lambda p: reports.flow_json(reports.detailed_flows(p)),
    f"select {_KEYS}, "
    + _json(
        _texts(("protocol", "upper(proto)"), ("state", "state"), ("source", "a_ip"), ("destination", "b_ip"))
        + _numbers(("source_port", "a_port"), ("destination_port", "b_port"))
        + _texts(("transport", "proto"))
        + _numbers(
            ("packets", "packets"), ("bytes", "bytes"), ("payload_bytes", "payload_bytes"), ("a_to_b_packets", "packets_forward"), ("a_to_b_bytes", "bytes_forward"),
            ("b_to_a_packets", "packets_backward"), ("b_to_a_bytes", "bytes_backward"), ("retransmissions", "retransmissions"), ("duration_us", "duration_us"),
        )
        + _texts(("application", "application"), ("info", "info"), ("mac_a", "a_mac"), ("mac_b", "b_mac"))
        + _numbers(("completed", "case when completed then 'true' end"))
        + [("http", "case when http_method is not null or http_status is not null then " + _json(_texts(("method", "http_method"), ("host", "http_host"), ("path", "http_uri")) + _numbers(("status", "http_status"))) + " end", "raw")]
        + [("dns", "case when dns_name is not null then " + _json(_texts(("query", "dns_name"))) + " end", "raw"), ("tls", "case when tls_sni is not null then " + _json(_texts(("sni", "tls_sni"))) + " end", "raw")]
    )
    + f" as json from {_DETAILED} join ({_FLOWS}) using ({_KEYS})",
)
_add(
    "packet_json",
    reports.packet_json,
    "select number, "
    + _json(
        _numbers(("number", "number"), ("ts_us", "ts_us"), ("length", "frame_len")) + _texts(("protocol", "protocol"), ("info", _INFO))
        + [("eth", _json(_texts(("src", "src_mac"), ("dst", "dst_mac")) + _numbers(("vlan", "vlan_id"))), "raw")]
        + [("arp", "case when kind = 'arp' then " + _json(_texts(("sender", "arp_sender_ip"), ("target", "arp_target_ip"))) + " end", "raw")]
        + [("ip", "case when ip_version > 0 then " + _json(_numbers(("version", "ip_version")) + _texts(("src", "src_ip"), ("dst", "dst_ip")) + _numbers(("ttl", "ttl"))) + " end", "raw")]
        + [("tcp", "case when proto = 'tcp' then " + _json(_numbers(("src_port", "src_port"), ("dst_port", "dst_port"), ("seq", "seq")) + _texts(("flags", _FLAGS)) + _numbers(("window", "tcp_window"))) + " end", "raw")]
        + [("udp", "case when proto = 'udp' then " + _json(_numbers(("src_port", "src_port"), ("dst_port", "dst_port"))) + " end", "raw")]
    )
    + " as json from packets",
)
# documents of several tables: read back and compared in the tests
_add("stats_json", reports.stats_json)
_add("analysis_json", lambda p: reports.analysis_json(p, field("http").exists()))

# ---- text reports -----------------------------------------------------------------------------

_CLASS = "case when frame_len >= 1520 then 6 when frame_len >= 1024 then 5 when frame_len >= 512 then 4 when frame_len >= 256 then 3 when frame_len >= 128 then 2 when frame_len >= 64 then 1 else 0 end"
_LABELS = ", ".join(f"({k}, '{label}')" for k, (_, label) in enumerate(stats.SIZE_CLASSES))
_add(
    "text_histogram",
    reports.text_histogram,
    f"select bucket, '  ' || {_pad('label', 12)} || {_pad('n::varchar', 10, True)} || ' ' || repeat('#', floor(40 * n / greatest(1, max(n) over ()))::int) as line from (select bucket, label, count(frame_len) as n from (values {_LABELS}) t(bucket, label) left join packets on bucket = {_CLASS} group by 1, 2)",
)
_percent = lambda x: f"(round(cast(100 * {x} / sum({x}) over () as decimal(18, 6)), 1)::decimal(18, 1)::varchar || '%')"
_add(
    "text_breakdown",
    reports.text_breakdown,
    f"select protocol, '  ' || {_pad('protocol', 16)} || {_pad('packets::varchar', 12, True)} || {_pad('ps', 9, True)} || {_pad('bytes::varchar', 14, True)} || {_pad('bs', 9, True)} as line from (select *, {_percent('packets')} as ps, {_percent('bytes')} as bs from (select protocol, count(*) as packets, sum(frame_len)::bigint as bytes from packets group by 1))",
)
_add(
    "text_layers",
    lambda p: reports.text_summary(p).where("line like 'Layers%' or line like 'TCP flags%'").select("line"),
    """select 'Layers: IPv4 ' || count_if(ip_version = 4) || ', IPv6 ' || count_if(ip_version = 6) || ', ARP ' || count_if(kind = 'arp') || ', TCP ' || count_if(proto = 'tcp') || ', UDP ' || count_if(proto = 'udp') || ', ICMP ' || count_if(proto = 'icmp') || ', other 0' as line from packets
  union all select 'TCP flags: SYN ' || count_if(tcp_flags & 18 = 2) || ', SYN/ACK ' || count_if(tcp_flags & 18 = 18) || ', FIN ' || count_if(tcp_flags & 1 = 1) || ', RST ' || count_if(tcp_flags & 4 = 4) from packets""",
)

# ---- scans ------------------------------------------------------------------------------------

_RANK = "case state when 'open' then 0 when 'closed' then 1 when 'filtered' then 2 when 'open|filtered' then 3 when 'unfiltered' then 4 else 5 end"
_RESULTS = f"select *, ({_RANK})::bigint * 1000000000 + seq as ord, case when seq % 4 = 0 then 'nginx' else '' end as product, case when seq % 5 = 0 then '1.' || (seq % 3) else '' end as version, case when seq % 7 = 0 then 'probe' else '' end as extra_info, (seq % 11)::int as confidence, case when seq % 6 = 0 then 'custom' else '' end as service, case when seq % 3 = 0 then 0 else tcp_window end as win from ({_PROBES})"


def _results(p: DataFrame) -> DataFrame:
    return p.withColumns(
        {
            "product": F.expr("case when seq % 4 = 0 then 'nginx' else '' end"),
            "version": F.expr("case when seq % 5 = 0 then '1.' || (seq % 3) else '' end"),
            "extra_info": F.expr("case when seq % 7 = 0 then 'probe' else '' end"),
            "confidence": F.expr("cast(seq % 11 as int)"),
            "service": F.expr("case when seq % 6 = 0 then 'custom' else '' end"),
            "tcp_window": F.expr("case when seq % 3 = 0 then 0 else tcp_window end"),
        }
    )


def _scan(name: str, build: Callable[[DataFrame, DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query over the hosts and the merged ports of the scan."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        probes = _probes(spark, sf_dir)
        results = _results(probes)
        ports = scans.finalize(results)
        return build(scans.host_systems(scans.host_results(probes), ports), ports)

    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = f"{PACKETS_CTE}, results as ({_RESULTS}), ports as ({_PORTS}), hosts as ({_HOSTS}) {sql}"


_first = lambda c: f"coalesce(arg_min({c}, ord) filter ({c} <> ''), '')"
_number = lambda c: f"coalesce(arg_min({c}, ord) filter ({c} <> 0), 0)"
_NAMES = "(values " + ", ".join(f"({p}, '{proto}', '{name}')" for p, proto, name in SERVICES) + ") as known(port, proto, name)"
_PORTS = f"""select m.* replace (case when m.service <> '' then m.service else coalesce(known.name, 'unknown') end as service) from (select scan_id, address, proto, port, arg_min(state, ord) as state, arg_min(service, ord) as service, {_first("banner")} as banner, {_first("product")} as product,
  {_first("version")} as version, {_first("extra_info")} as extra_info, {_number("rtt_us")} as rtt_us, {_number("ttl")} as ttl, {_number("win")} as tcp_window, max(confidence) as confidence from results group by 1, 2, 3, 4) m left join {_NAMES} on m.port = known.port and m.proto = known.proto"""
_OS = """case when w = 8192 then 'Windows XP/2003' when w = 64240 then 'Linux 5.x+ or Windows 10+' when ttl <= 64 then 'Linux/Unix/macOS (TTL <= 64)' when ttl <= 128 then 'Windows (TTL <= 128)' else 'Network device / Solaris (TTL > 128)' end"""
_HOSTS = f"""select scan_id, address, true as up, latency_us, h.ttl, tcp_window, {_OS} as os_guess from (select scan_id, address, arg_min(rtt_us, seq) as latency_us, arg_min(ttl, seq) filter (ttl > 0) as ttl, arg_min(tcp_window, seq) filter (tcp_window > 0) as tcp_window from ({_PROBES}) group by 1, 2) h
  left join (select scan_id, address, arg_min(tcp_window, port) as w from ports where proto = 'tcp' and tcp_window <> 0 group by 1, 2) using (scan_id, address)"""
_scan("scan_ports", lambda hosts, ports: ports, "select * from ports")
_scan("scan_systems", lambda hosts, ports: hosts.select("address", "ttl", "os_guess"), "select address, ttl, os_guess from hosts")
_scan("scan_summary", reports.scan_summary, "select scan_id, (select count(*) from hosts) as hosts_total, (select count(*) from hosts) as hosts_up, count_if(state = 'open')::bigint as ports_open, count_if(state = 'closed')::bigint as ports_closed, count_if(state in ('filtered', 'open|filtered'))::bigint as ports_filtered from ports group by 1")
_scan("scan_top_ports", lambda hosts, ports: reports.top_open_ports(ports), f"select t.port, hosts, coalesce(name, 'unknown') as service from (select port, count(distinct address) as hosts from ports where state = 'open' group by 1 order by 2 desc, 1 limit 12) t left join {_NAMES} on known.port = t.port and known.proto = 'tcp'")
_TEXT = "concat_ws(' ', nullif(product, ''), nullif(version, ''))"
_scan(
    "scan_port_lines",
    lambda hosts, ports: reports.scan_port_lines(ports),
    f"""select scan_id, address, proto, port, {_pad("(port || '/' || proto)", 10)} || {_pad("state", 14)} || {_pad("service", 18)} || {_TEXT} as line, concat_ws(' ', service, nullif(product, ''), nullif(version, '')) as service_text from ports""",
)


def _named(hosts: DataFrame) -> DataFrame:
    """Hosts with what the scan rows of the tests need besides."""
    mac = F.when(F.col("ttl") > 64, "00:50:56:00:00:01").otherwise("00:00:00:00:00:00")
    return hosts.withColumns({"hostname": F.concat(F.lit('h "x"\n'), "address"), "mac": mac, "up_reason": F.lit("syn-ack")})


_scan(
    "scan_csv",
    lambda hosts, ports: reports.scan_rows(_named(hosts), ports.where("port <> 53")),
    """select h.scan_id, h.address as host, 'h "x"' || h.address as hostname, case when h.ttl > 64 then '00:50:56:00:00:01' else '' end as mac, case when h.ttl > 64 then 'VMware' else '' end as mac_vendor, up, 'syn-ack' as up_reason, latency_us, h.ttl, os_guess,
  port, proto as protocol, state, service, product, version, extra_info, confidence, rtt_us, banner from hosts h left join (select * from ports where port <> 53) p on h.address = p.address""",
)
_scan(
    "scan_json",
    reports.scan_json,
    "select scan_id, h.address, " + _json(_texts(("address", "h.address")) + _numbers(("up", "'true'"), ("latency_us", "latency_us"), ("ttl", "ttl")) + _texts(("os_guess", "os_guess")) + [("ports", "'[' || list || ']'", "raw")]) + " as json from hosts h join (select address, string_agg("
    + _json(_texts(("proto", "proto")) + _numbers(("port", "port")) + _texts(("state", "state"), ("service", "service"), ("product", "nullif(product, '')"), ("version", "nullif(version, '')"), ("banner", "nullif(banner, '')")))
    + ", ',' order by proto, port) as list from ports group by 1) p on h.address = p.address",
)

# ---- store ------------------------------------------------------------------------------------

_add("store_flows", lambda p: store.flow_report(W.flows(p).select(*W.KEY, "bytes").withColumn("capture_id", F.concat(F.lit("c"), (F.col("b_port") % 2).cast("string"))), "c1", 50), f"select {_KEYS}, bytes, 'c1' as capture_id from ({_FLOWS}) where b_port % 2 = 1 order by bytes desc, {_KEYS} limit 50")
_add("store_packets", lambda p: store.packet_report(p.select("number", "protocol", "frame_len", F.concat(F.lit("c"), (F.col("number") % 9).cast("string")).alias("capture_id")), "c4", 60), "select number, protocol, frame_len, 'c4' as capture_id from packets where number % 9 = 4 order by number desc limit 60")
_add("store_kept_flows", lambda p: store.stored_flows(W.flows(p).select(*W.KEY, "last_us"), "c1"), f"select {_KEYS}, last_us, 'c1' as capture_id from ({_FLOWS}) order by last_us desc, {_KEYS} limit 5000")

# ---- names ------------------------------------------------------------------------------------


def _cases(column: str, names: dict[int, str], other: str) -> str:
    return f"case {column} " + " ".join(f"when {k} then '{v}'" for k, v in names.items()) + f" else {other} end"


def _distinct(value: str, columns: Callable[[Column], dict[str, Column]]) -> Callable[[DataFrame], DataFrame]:
    """What functions make of the distinct values of a Spark SQL expression."""
    return lambda p: p.select(F.expr(value).alias("_v")).distinct().select(*[c.alias(n) for n, c in columns(F.col("_v")).items()])


_add(
    "tls_names",
    _distinct("number % 1024", lambda c: {"code": c, "version": N.tls_version(c), "suite": N.tls_suite(c), "alert": N.tls_alert(c % 128), "label": N.tls_label(c), "link": N.link_name(c)}),
    f"select distinct code, {_cases('code', N.TLS_VERSIONS, _hex := "'0x' || printf('%04x', code)")} as version, {_cases('code', N.TLS_SUITES, _hex)} as suite, {_cases('code % 128', N.TLS_ALERTS, "'alert ' || (code % 128)")} as alert, case when code >= 772 then 'TLS 1.3' when code = 771 then 'TLS 1.2' when code > 0 then 'TLS 1.x/SSL' end as label, {_cases('code', N.LINKS, "'UNKNOWN'")} as link from (select number % 1024 as code from packets)",
)
_add(
    "netmasks",
    _distinct("cast(number % 33 as int)", lambda c: {"prefix": c, "mask": N.netmask(c), "back": N.netmask_prefix(N.netmask(c))}),
    "select distinct p as prefix, 4294967296 - (1::bigint << (32 - p)) as mask, p as back from (select (number % 33)::int as p from packets)",
)
_add(
    "proto_spellings",
    _distinct("array(' TCP ', '6', 't', 'U', '17', 'icmp', '1', 'sctp')[cast(number % 8 as int)]", lambda c: {"text": c, "proto": N.parse_proto(c, "other")}),
    "select distinct s as text, case when lower(trim(s)) in ('tcp', 't', '6') then 'tcp' when lower(s) in ('udp', 'u', '17') then 'udp' when s in ('icmp', 'i', '1') then 'icmp' else 'other' end as proto from (select [' TCP ', '6', 't', 'U', '17', 'icmp', '1', 'sctp'][number % 8 + 1] as s from packets)",
)
_add(
    "answers_text",
    lambda p: p.where("dns_qname is not null").select("number", N.answers_text(F.array("src_ip", F.lit(""), "dst_ip", F.lit(None), "dns_qname", "proto", "kind")).alias("answers")),
    "select number, concat_ws(', ', src_ip, dst_ip, dns_qname, proto) as answers from packets where dns_qname is not null",
)
