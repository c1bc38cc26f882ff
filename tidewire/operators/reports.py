"""Info lines, JSON documents, text lines and flat rows of packets, flows and scans.

Documents of a whole capture hold counters and top lists only, so they are one bounded row;
what grows with the input stays a row for each packet, flow, port or host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.decode import info
from tidewire.functions import packet as P
from tidewire.functions.ip import ipv4_key
from tidewire.functions.lookups import icmp_name, service_name, vendor_name
from tidewire.functions.names import filled, port_line, port_state_rank, service_text
from tidewire.functions.text import human_bytes, truncate
from tidewire.operators import flows as W
from tidewire.operators import scans, stats
from tidewire.sinks.exports import clean, flow_rows, packet_rows

ARROW = " → "


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _application_info(packets: DataFrame) -> Column:
    """What a flow shows of a packet's application: HTTP start line, DNS question or reply, else its summary; NULL without one."""
    method = F.coalesce(F.col("http_method"), F.lit(""))
    status = _text("HTTP/1.1 ", F.col("http_status"), " ", F.col("http_reason"))
    http = F.when(method != "", _text(method, " ", F.coalesce(F.col("http_uri"), F.lit("")))).when(F.col("http_status") > 0, status)
    reply = _text("response ", F.col("dns_qname"), " (", F.col("dns_rcode"), ")")
    dns = F.when(F.col("dns_response"), reply).otherwise(_text(F.col("dns_type"), "? ", F.col("dns_qname")))
    return F.coalesce(http, dns, F.col("summary"))


def packet_info(packets: DataFrame) -> Column:
    """What a packet says in one line: that of its frame where it was decoded, else by its columns.

    Columns that are NULL say nothing; no value stands in for them.
    """
    if "info" in packets.columns:
        return F.col("info")
    arp = info.arp(F.col("arp_opcode"), F.col("arp_sender_ip"), F.col("arp_target_ip"), F.col("src_mac"))
    ends = _text(F.col("src_port"), ARROW, F.col("dst_port"))
    tcp = _text(ends, " [", P.flags_text(), "] Seq=", F.col("seq"), " Ack=", F.col("ack"), " Win=", F.col("tcp_window"), " Len=", F.col("payload_len"), F.when(F.col("l4_checksum_ok"), "").otherwise(" [checksum invalid]"))
    icmp = _text(icmp_name(F.col("icmp_type"), F.col("icmp_code"), F.col("ip_version") == 6), " len=", F.col("payload_len"))
    out = F.when(F.col("kind") == "arp", arp).when(F.col("proto") == "icmp", icmp).when(F.col("summary").isNotNull(), F.col("summary"))
    out = out.when(F.col("proto") == "tcp", tcp).when(F.col("proto") == "udp", _text(ends, " Len=", F.col("payload_len")))
    if "malformed" in packets.columns:
        reason = F.col("malformed_reason") if "malformed_reason" in packets.columns else F.lit(None).cast("string")
        out = F.when(F.col("malformed"), F.concat(F.lit("[Malformed packet"), F.coalesce(_text(": ", reason), F.lit("")), F.lit("]"))).otherwise(out)
    return F.concat(F.coalesce(out, F.lit("")), F.when(F.coalesce(F.col("truncated"), F.lit(False)), " [truncated]").otherwise(""))


def packet_lines(packets: DataFrame, width: int = 0) -> DataFrame:
    """number and a line of number, time of day, both ends, protocol (``BAD`` if malformed), length and info."""
    ends = [filled(truncate(P.source_text(f"{s}_ip", f"{s}_port", f"{s}_mac"), 22), 24) for s in ("src", "dst")]
    bad = F.col("malformed") if "malformed" in packets.columns else F.lit(False)
    name = F.when(bad, "BAD").when(F.coalesce(F.col("protocol"), F.lit("")) == "", "-").otherwise(F.col("protocol"))
    used = 7 + 17 + 24 + 24 + 8 + 7
    info = packet_info(packets)
    info = info if width <= 0 else truncate(info, width - used if width > used else 20)
    second = F.expr("ts_us div 1000000")
    clock = F.format_string("%02d:%02d:%02d.%06d", F.floor(second / 3600) % 24, F.floor(second / 60) % 60, second % 60, F.col("ts_us") % 1_000_000)
    line = F.concat(filled(F.col("number").cast("string"), 7, True), filled(clock, 17), *ends, filled(truncate(name, 7), 8), filled(F.col("frame_len").cast("string"), 7, True), info)
    return packets.select("number", line.alias("line"))


def detailed_flows(packets: DataFrame) -> DataFrame:
    """Flows with ``info``, the HTTP method and whether they were closed or reset.

    ``info`` is the last application line of the flow, else ``connection reset`` if it began
    with a reset, else the line of its first packet that has one.
    """
    spoken = packets.withColumns({"_application": _application_info(packets), "_info": packet_info(packets)})
    number, ends = F.col("number"), P.is_rst() | P.is_fin()
    more = [
        F.max_by("_application", F.when(F.col("_application").isNotNull(), number)).alias("strong_info"),
        F.min_by("_info", F.when(F.col("_info") != "", number)).alias("weak_info"),
        F.coalesce(F.min_by(P.is_rst(), "number"), F.lit(False)).alias("begins_reset"),
        F.max_by("http_method", F.when(F.col("http_method") != "", number)).alias("http_method"),
        F.coalesce(F.bool_or(ends), F.lit(False)).alias("completed"),
    ]
    info = F.coalesce("strong_info", F.when(F.col("begins_reset"), "connection reset"), "weak_info", F.lit(""))
    return W.flows(spoken, *more).withColumn("info", info).drop("strong_info", "weak_info", "begins_reset")


def flow_lines(found: DataFrame, limit: int, sort: str = "last") -> DataFrame:
    """Key and line of the first of detailed flows, in one of the named orders."""
    end = lambda s: filled(truncate(F.when(F.col(f"{s}_port") > 0, _text(F.col(f"{s}_ip"), ":", F.col(f"{s}_port"))).otherwise(F.col(f"{s}_ip")), 30), 32)
    count = lambda c, w: filled(F.col(c).cast("string"), w, True)
    line = F.concat(
        filled(F.upper("proto"), 7), end("a"), end("b"), count("packets", 9), count("bytes", 12), F.lit(" "),
        filled(F.col("state"), 13), filled(truncate(F.coalesce("application", F.lit("")), 14), 16), truncate(F.col("info"), 48),
    )
    return W.listed(found, sort, limit).select(*W.KEY, line.alias("line"))


def flow_json(found: DataFrame) -> DataFrame:
    """The flow key and a JSON document of each detailed flow; keys without a value are left out."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    http = F.when(F.col("http_method").isNotNull() | F.col("http_status").isNotNull(), F.struct(F.col("http_method").alias("method"), F.col("http_host").alias("host"), F.col("http_uri").alias("path"), F.col("http_status").alias("status")))
    document = F.struct(
        F.upper("proto").alias("protocol"), "state", F.col("a_ip").alias("source"), F.col("b_ip").alias("destination"), F.col("a_port").alias("source_port"), F.col("b_port").alias("destination_port"),
        F.col("proto").alias("transport"), "packets", "bytes", "payload_bytes", F.col("packets_forward").alias("a_to_b_packets"), F.col("bytes_forward").alias("a_to_b_bytes"),
        F.col("packets_backward").alias("b_to_a_packets"), F.col("bytes_backward").alias("b_to_a_bytes"), "retransmissions", "duration_us", some("application").alias("application"), some("info").alias("info"),
        F.col("a_mac").alias("mac_a"), F.col("b_mac").alias("mac_b"), F.when(F.col("completed"), True).alias("completed"), http.alias("http"),
        F.when(F.col("dns_name").isNotNull(), F.struct(F.col("dns_name").alias("query"))).alias("dns"), F.when(F.col("tls_sni").isNotNull(), F.struct(F.col("tls_sni").alias("sni"))).alias("tls"),
    )
    return found.select(*W.KEY, F.to_json(document).alias("json"))


def packet_json(packets: DataFrame) -> DataFrame:
    """number and a JSON document of each packet, a part for each layer that it has."""
    layer = lambda given, *columns: F.when(given, F.struct(*columns))
    document = F.struct(
        "number", "ts_us", F.col("frame_len").alias("length"), "protocol", packet_info(packets).alias("info"),
        F.struct(F.col("src_mac").alias("src"), F.col("dst_mac").alias("dst"), F.col("vlan_id").alias("vlan")).alias("eth"),
        layer(F.col("kind") == "arp", F.col("arp_sender_ip").alias("sender"), F.col("arp_target_ip").alias("target")).alias("arp"),
        layer(F.col("ip_version") > 0, F.col("ip_version").alias("version"), F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), "ttl").alias("ip"),
        layer(F.col("proto") == "tcp", "src_port", "dst_port", "seq", P.flags_text().alias("flags"), F.col("tcp_window").alias("window")).alias("tcp"),
        layer(F.col("proto") == "udp", "src_port", "dst_port").alias("udp"),
    )
    return packets.select("number", F.to_json(document).alias("json"))


def _gathered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """A bounded list as one array in one row, in the given order."""
    columns = [F.col(c) for c in rows.columns]
    listed = F.sort_array(F.collect_list(F.struct(*[o.alias(f"_{k}") for k, o in enumerate(order)], F.struct(*columns).alias("row"))))
    return rows.agg(F.transform(listed, lambda x: x["row"]).alias(name))


def stats_json(packets: DataFrame, n: int = 10) -> DataFrame:
    """One row with one JSON document: counters, protocols, top lists and size classes."""
    totals = stats.totals(packets)
    part = lambda name, *columns: F.struct(*columns).alias(name)
    counters = totals.select(
        "packets", "bytes", "ip_bytes", "payload_bytes", "min_size", "max_size", "first_us", "last_us",
        part("layers", "ipv4", "ipv6", "arp", "tcp", "udp", "icmp", "other"), part("issues", "malformed", "bad_checksums", "fragments"),
        part("tcp_flags", "syn", "syn_ack", "fin", "rst"), part("application", "dns", "http", "tls", "dhcp", "ntp"),
    )
    lists = [
        _gathered(stats.protocol_breakdown(packets).select("protocol", "packets", "bytes"), "protocols", -F.col("packets"), F.col("protocol")),
        _gathered(stats.top_talkers(packets, n), "talkers", -(F.col("tx_bytes") + F.col("rx_bytes")), -(F.col("tx_packets") + F.col("rx_packets")), F.col("ip")),
        _gathered(stats.top_ports(packets, "tcp", n), "tcp_ports", -F.col("packets"), -F.col("bytes"), F.col("port")),
        _gathered(stats.top_ports(packets, "udp", n), "udp_ports", -F.col("packets"), -F.col("bytes"), F.col("port")),
        _gathered(stats.size_histogram(packets).select("label", "packets", "bucket"), "sizes", F.col("bucket")),
    ]
    for one in lists:
        counters = counters.crossJoin(F.broadcast(one))  # one row each
    return counters.select(F.to_json(F.struct("*")).alias("json"))


def analysis_json(packets: DataFrame, matched: Column, flows: int = 100, n: int = 10) -> DataFrame:
    """One document of the run's summary, the statistics and the flows that were seen last."""
    key = [F.col(k) for k in W.KEY]
    first = W.listed(detailed_flows(packets), "last", flows)
    listed = _gathered(first, "sessions", -F.col("last_us"), *key)
    summary = stats.run_summary(packets, matched).select(F.struct("*").alias("summary"))
    document = summary.crossJoin(F.broadcast(stats_json(packets, n).withColumnRenamed("json", "stats"))).crossJoin(F.broadcast(listed))
    return document.select(F.to_json(F.struct("summary", "sessions")).alias("head"), "stats").select(F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"stats":'), F.col("stats"), F.lit("}")).alias("json"))


def text_histogram(packets: DataFrame, width: int = 40) -> DataFrame:
    """bucket and a line for each size class with a bar; the largest class has the full width."""
    sizes = stats.size_histogram(packets)
    most = sizes.agg(F.greatest(F.lit(1), F.max("packets")).alias("_most"))
    bar = F.repeat(F.lit("#"), F.floor(F.lit(width) * F.col("packets") / F.col("_most")).cast("int"))
    line = F.concat(F.lit("  "), filled(F.col("label"), 12), filled(F.col("packets").cast("string"), 10, True), F.lit(" "), bar)
    return sizes.crossJoin(F.broadcast(most)).select("bucket", line.alias("line"))


def text_summary(packets: DataFrame) -> DataFrame:
    """line number and text of a capture's counters."""
    c = F.col
    lines = [
        _text("Packets:        ", c("packets")),
        _text("Bytes:          ", c("bytes"), " (", human_bytes(c("bytes")), ")"),
        _text("IP bytes:       ", c("ip_bytes"), "   payload bytes: ", c("payload_bytes")),
        _text("Layers: IPv4 ", c("ipv4"), ", IPv6 ", c("ipv6"), ", ARP ", c("arp"), ", TCP ", c("tcp"), ", UDP ", c("udp"), ", ICMP ", c("icmp"), ", other ", c("other")),
        _text("Application: DNS ", c("dns"), ", HTTP ", c("http"), ", TLS ", c("tls"), ", DHCP ", c("dhcp"), ", NTP ", c("ntp")),
        _text("TCP flags: SYN ", c("syn"), ", SYN/ACK ", c("syn_ack"), ", FIN ", c("fin"), ", RST ", c("rst")),
        _text("Anomalies: malformed ", c("malformed"), ", bad checksums ", c("bad_checksums"), ", fragments ", c("fragments")),
        _text("Broadcast/multicast: ", c("broadcast"), " / ", c("multicast")),
    ]
    return stats.totals(packets).select(F.posexplode(F.array(*lines)).alias("n", "line"))


def text_breakdown(packets: DataFrame) -> DataFrame:
    """protocol and its line of packets, bytes and shares in percent; unnamed ones are left out."""
    share = lambda s: F.format_string("%.1f%%", F.col(s))
    line = F.concat(F.lit("  "), filled(F.col("protocol"), 16), *[filled(v, w, True) for v, w in ((F.col("packets").cast("string"), 12), (share("packet_share"), 9), (F.col("bytes").cast("string"), 14), (share("byte_share"), 9))])
    return stats.protocol_breakdown(packets).where("protocol <> 'unknown'").select("protocol", line.alias("line"))


def scan_rows(hosts: DataFrame, ports: DataFrame) -> DataFrame:
    """Twenty columns: a row for each port, and one with empty port columns for a host without any."""
    text = lambda c: clean(F.col(c))
    real = vendor_name(hosts.withColumn("mac", F.when(F.col("mac") != "00:00:00:00:00:00", F.col("mac"))))
    named = real.select("scan_id", "address", text("hostname").alias("hostname"), text("mac").alias("mac"), text("vendor").alias("mac_vendor"), "up", text("up_reason").alias("up_reason"), "latency_us", F.col("ttl"), text("os_guess").alias("os_guess"))
    results = ports.select("scan_id", "address", "port", F.col("proto").alias("protocol"), "state", *[text(c).alias(c) for c in ("service", "product", "version", "extra_info")], "confidence", "rtt_us", text("banner").alias("banner"))
    return named.join(results, ["scan_id", "address"], "left").withColumnRenamed("address", "host")


def sorted_ports(ports: DataFrame) -> DataFrame:
    """Ports in the order of a report: address, protocol, number, state."""
    proto = F.when(F.col("proto") == "tcp", 0).when(F.col("proto") == "udp", 1).otherwise(2)
    address = F.coalesce(ipv4_key(F.col("address")), F.concat(F.lit("06"), F.col("address")))
    return ports.orderBy("scan_id", address, proto, "port", port_state_rank(F.col("state")))


def top_open_ports(ports: DataFrame, n: int = 12) -> DataFrame:
    """The ports that most hosts have open, with the service of their number."""
    counted = scans.open_port_histogram(ports).withColumn("proto", F.lit("tcp"))
    return service_name(counted.orderBy(F.desc("hosts"), "port").limit(n)).drop("proto")


def scan_port_lines(ports: DataFrame, only_open: bool = False) -> DataFrame:
    """scan_id, address, proto, port and the line of each port, with its full service text."""
    rows = ports.where("state = 'open'") if only_open else ports
    c = F.col
    line = port_line(c("port"), c("proto"), c("state"), c("service"), c("product"), c("version"))
    return rows.select("scan_id", "address", "proto", "port", line.alias("line"), service_text(c("service"), c("product"), c("version")).alias("service_text"))


def scan_json(hosts: DataFrame, ports: DataFrame, closed: bool = True) -> DataFrame:
    """scan_id, address and a JSON document of each host with its ports, of which it has at most 131070."""
    some = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    rows = ports if closed else ports.where("state = 'open'")
    port = F.struct("proto", "port", "state", some("service"), some("product"), some("version"), some("banner"))
    listed = rows.groupBy("scan_id", "address").agg(F.sort_array(F.collect_list(port)).alias("ports"))
    return hosts.join(listed, ["scan_id", "address"], "left").select("scan_id", "address", F.to_json(F.struct("address", "up", "latency_us", "ttl", some("os_guess"), F.coalesce("ports", F.array().cast(listed.schema["ports"].dataType)).alias("ports"))).alias("json"))


def scan_summary(hosts: DataFrame, ports: DataFrame) -> DataFrame:
    """One row per scan: hosts, hosts that are up, and ports by state."""
    state = lambda *names: F.count_if(F.col("state").isin(*names))
    counted = ports.groupBy("scan_id").agg(state("open").alias("ports_open"), state("closed").alias("ports_closed"), state("filtered", "open|filtered").alias("ports_filtered"))
    of_hosts = hosts.groupBy("scan_id").agg(F.count(F.lit(1)).alias("hosts_total"), F.count_if("up").alias("hosts_up"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("ports_open", "ports_closed", "ports_filtered")]
    return of_hosts.join(counted, "scan_id", "left").select("scan_id", "hosts_total", "hosts_up", *zero)


def export(kind: str, form: str, **tables: DataFrame) -> DataFrame:
    """Rows of a capture (``packets``) or scan (``hosts``, ``ports``) in a form: flat rows for csv, documents for json, lines for text."""
    if kind == "capture":
        forms = {"csv": packet_rows, "json": packet_json, "text": packet_lines}
        given = (tables["packets"],)
    elif kind == "flows":
        forms = {"csv": flow_rows, "json": flow_json}
        given = (tables["flows"],)
    elif kind == "scan":
        forms = {"csv": scan_rows, "json": scan_json, "text": lambda hosts, ports: scan_port_lines(ports)}
        given = (tables["hosts"], tables["ports"])
    else:
        raise ValueError(f"no such export: {kind}")
    if form not in forms:
        raise ValueError(f"{kind} has no form {form}")
    return forms[form](*given)
