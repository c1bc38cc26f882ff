"""Logical packets from the ``events`` table.

The test tables hold no captures, so each event stands for one packet.  Every column is
integer or text arithmetic on the event, written once as SQL that Spark and DuckDB both
understand; only the words in braces differ between the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK = {"div": "div", "epoch_us": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"}
_DUCKDB = {"div": "//", "epoch_us": "epoch_us(ts)"}

#: (column, expression over the event and the columns before it), layer by layer.
_LAYERS: list[list[tuple[str, str]]] = [
    [
        ("number", "event_id + 1"),
        ("e", "event_id"),
        ("u", "user_id"),
        ("ts_us", "cast({epoch_us} as bigint)"),
        ("srv", "event_id % 4"),
        ("kind", "case when event_id % 17 = 0 then 'arp' when event_type = 'click' then 'http' when event_type = 'view' then 'tls' when event_type = 'purchase' then 'dns' when event_type = 'signup' then 'tcp' else 'icmp' end"),
        ("v6", "event_id % 23 = 0 and event_id % 17 <> 0"),
        ("back", "event_id % 2 = 1"),
        ("size", "cast(floor(value) as bigint) % 400"),
    ],
    [
        ("number", "number"),
        ("e", "e"),
        ("ts_us", "ts_us"),
        ("kind", "kind"),
        ("v6", "v6"),
        ("back", "back"),
        ("proto", "case when kind in ('http', 'tls', 'tcp') then 'tcp' when kind = 'dns' then 'udp' when kind = 'icmp' then 'icmp' else 'other' end"),
        ("protocol", "case kind when 'http' then 'HTTP' when 'tls' then 'TLSv1.2' when 'dns' then 'DNS' when 'tcp' then 'TCP' when 'icmp' then 'ICMP' else 'ARP' end"),
        ("client_int", "167772160 + u"),
        ("server_int", "3232235520 + 256 * case kind when 'http' then 1 when 'tls' then 2 when 'dns' then 3 when 'tcp' then 4 else 5 end + srv + 1"),
        ("client_port", "cast(case when kind in ('icmp', 'arp') then 0 when e % 3 = 0 then 50000 + e % 4000 else 40000 + u % 8 end as int)"),
        ("server_port", "cast(case kind when 'http' then case when srv = 3 then 8080 else 80 end when 'tls' then 443 when 'dns' then 53 when 'tcp' then case srv when 0 then 22 when 1 then 25 when 2 then 3306 else 9999 end else 0 end as int)"),
        ("flag_at", "e % 11"),
        ("payload_len", "cast(case when kind = 'arp' then 0 when kind = 'icmp' then 8 else size end as int)"),
        ("vlan_id", "cast(case when e % 29 = 0 then 100 + e % 3 end as int)"),
        ("u", "u"),
        ("srv", "srv"),
        ("e10", "e % 10"),
        ("dns_code", "case when back and e % 10 = 7 then 3 when back and e % 10 = 9 then 2 else 0 end"),
        ("qname", "'host' || (u % 50) || '.example.com'"),
        ("asked", "u % 8"),
        ("unreachable", "kind = 'icmp' and not v6 and e % 13 = 0"),
    ],
    [
        ("number", "number"),
        ("ts_us", "ts_us"),
        ("kind", "kind"),
        ("proto", "proto"),
        ("protocol", "protocol"),
        ("ip_version", "cast(case when kind = 'arp' then 0 when v6 then 6 else 4 end as int)"),
        ("client_text", "case when v6 then '2001:db8::' || printf('%x', u + 1) else '10.' || ((client_int {div} 65536) % 256) || '.' || ((client_int {div} 256) % 256) || '.' || (client_int % 256) end"),
        ("server_text", "case when v6 then '2001:db8:1::' || printf('%x', srv + 1) else '192.168.' || ((server_int {div} 256) % 256) || '.' || (server_int % 256) end"),
        ("client_key", "case when v6 then '0620010db8' || printf('%024x', u + 1) else '04' || printf('%08x', client_int) end"),
        ("server_key", "case when v6 then '0620010db80001' || printf('%020x', srv + 1) else '04' || printf('%08x', server_int) end"),
        ("client_mac", "'02:aa:bb:01:' || printf('%02x', (u {div} 256) % 256) || ':' || printf('%02x', u % 256)"),
        ("server_mac", "'00:50:56:00:' || printf('%02x', (server_int {div} 256) % 256) || ':' || printf('%02x', srv)"),
        ("client_port", "client_port"),
        ("server_port", "server_port"),
        ("back", "back"),
        ("tcp_flags", "cast(case when proto <> 'tcp' then 0 when flag_at in (0, 9) then 2 when flag_at = 1 then 18 when flag_at in (2, 7, 10) then 16 when flag_at in (3, 8) then 24 when flag_at = 4 then 17 when flag_at = 5 then 4 else 0 end as int)"),
        ("seq", "case when proto = 'tcp' then (e * 37) % 5000 else 0 end"),
        ("ack", "case when proto = 'tcp' then (e * 37) % 5000 + 1 else 0 end"),
        ("arp_opcode", "cast(case when kind = 'arp' then case when back then 2 else 1 end end as int)"),
        ("icmp_type", "cast(case when kind = 'icmp' then case when unreachable then 3 when v6 then case when back then 129 else 128 end when back then 0 else 8 end end as int)"),
        ("icmp_code", "cast(case when kind = 'icmp' then case when unreachable then e % 3 else 0 end end as int)"),
        ("dns_response", "case when kind = 'dns' then back end"),
        ("dns_record", "case when kind = 'dns' then case asked when 0 then 'A' when 1 then 'AAAA' when 2 then 'MX' when 3 then 'TXT' when 4 then 'CNAME' when 5 then 'SOA' when 6 then 'SRV' else 'CAA' end end"),
        ("dns_rcode", "case when kind = 'dns' then case dns_code when 3 then 'Non-existent domain (NXDOMAIN)' when 2 then 'Server failure' else 'No error' end end"),
        ("dns_answer", "case when kind = 'dns' and back and dns_code = 0 then case asked when 0 then '93.184.' || (u % 256) || '.' || (e % 256) when 1 then '2001:db8:53::' || printf('%x', u + 1) when 2 then '10 mail' || (u % 7) || '.' || qname when 3 then 'v=' || u || ' k' || e10 when 4 then 'alias' || (u % 9) || '.' || qname when 5 then 'ns.' || qname || ' admin.' || qname || ' ' || e || ' 3600 600 86400 300' when 6 then '1 2 ' || (8000 + u % 100) || ' srv.' || qname else 'issue \"ca' || (u % 5) || '.example\"' end end"),
        ("http_reason", "case when kind = 'http' and back then case when e % 10 = 3 then 'Not Found' else 'OK' end end"),
        ("payload_len", "payload_len"),
        ("frame_len", "cast(case when kind = 'arp' then 42 else 14 + case when v6 then 40 else 20 end + case proto when 'tcp' then 20 else 8 end + payload_len end + case when vlan_id is null then 0 else 4 end as int)"),
        ("vlan_id", "vlan_id"),
        ("ttl", "cast(case when kind = 'arp' then 0 when e % 5 = 0 then 128 when e % 7 = 0 then 255 else 64 end as int)"),
        ("tcp_window", "cast(case when proto = 'tcp' then case when e % 5 = 0 then 8192 else 64240 end else 0 end as int)"),
        ("ip_checksum_ok", "v6 or e % 31 <> 0"),
        ("l4_checksum_ok", "kind in ('icmp', 'arp') or e % 37 <> 0"),
        ("truncated", "e % 41 = 0"),
        ("dns_qname", "case when kind = 'dns' then qname end"),
        ("http_method", "case when kind = 'http' and not back then case when e % 6 = 0 then 'POST' else 'GET' end end"),
        ("http_host", "case when kind = 'http' then case when back then '' else 'www' || srv || '.example.org' end end"),
        ("http_uri", "case when kind = 'http' then case when back then '' else '/item/' || (u % 20) || '?q=a%20b+' || (e % 7) end end"),
        ("http_status", "cast(case when kind = 'http' then case when back then case when e % 10 = 3 then 404 else 200 end else 0 end end as int)"),
        ("tls_sni", "case when kind = 'tls' then case when back then '' else 'api' || srv || '.example.net' end end"),
    ],
    [
        *[(c, c) for c in ("number", "ts_us", "kind", "proto", "protocol", "ip_version")],
        ("src_ip", "case when kind = 'arp' then null when back then server_text else client_text end"),
        ("dst_ip", "case when kind = 'arp' then null when back then client_text else server_text end"),
        ("src_ip_key", "case when kind = 'arp' then null when back then server_key else client_key end"),
        ("dst_ip_key", "case when kind = 'arp' then null when back then client_key else server_key end"),
        ("arp_sender_ip", "case when kind = 'arp' then case when back then server_text else client_text end end"),
        ("arp_target_ip", "case when kind = 'arp' then case when back then client_text else server_text end end"),
        ("arp_sender_key", "case when kind = 'arp' then case when back then server_key else client_key end end"),
        ("arp_target_key", "case when kind = 'arp' then case when back then client_key else server_key end end"),
        ("src_mac", "case when back then server_mac else client_mac end"),
        ("dst_mac", "case when kind = 'arp' then 'ff:ff:ff:ff:ff:ff' when back then client_mac else server_mac end"),
        ("src_port", "case when back then server_port else client_port end"),
        ("dst_port", "case when back then client_port else server_port end"),
        ("dns_type", "case when dns_record = 'CAA' then 'TYPE257' else dns_record end"),
        ("summary", """case kind when 'dns' then 'Standard query' || case when not dns_response then '' else ' response' || case when dns_rcode = 'No error' then '' else ' ' || dns_rcode end end || ' ' || dns_record || ' ' || coalesce(dns_answer, dns_qname)
          when 'http' then case when back then 'HTTP/1.1 ' || http_status || ' ' || http_reason || ' (2 bytes)' else http_method || ' ' || http_uri || ' (Host: ' || http_host || ')' end
          when 'tls' then case when back then 'TLS 1.2 Application Data (TLS 1.2)' else 'TLS 1.2 Client Hello (SNI=' || tls_sni || ')' end end"""),
        *[(c, c) for c in ("dns_record", "ack", "arp_opcode", "icmp_type", "icmp_code", "dns_response", "dns_rcode", "dns_answer", "http_reason", "tcp_flags", "seq", "payload_len", "frame_len", "vlan_id", "ttl", "tcp_window", "ip_checksum_ok", "l4_checksum_ok", "truncated", "dns_qname", "http_method", "http_host", "http_uri", "http_status", "tls_sni")],
    ],
]


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logical packet per event; lazily built, all columns prune to the scan."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    for layer in _LAYERS:
        df = df.selectExpr(*[f"{expr.format(**_SPARK)} as {name}" for name, expr in layer])
    return df


def _duckdb_cte() -> str:
    parts, source = [], "events"
    for k, layer in enumerate(_LAYERS):
        name = "packets" if k == len(_LAYERS) - 1 else f"layer{k}"
        columns = ", ".join(f"{expr.format(**_DUCKDB)} as {column}" for column, expr in layer)
        parts.append(f"{name} as (select {columns} from {source})")
        source = name
    return "with " + ",\n".join(parts)


#: Prepended to the checking SQL; the last table is ``packets``.
PACKETS_CTE = _duckdb_cte()
