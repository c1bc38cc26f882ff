"""What a frame says in one line, by its layers; texts are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.decode.binary import part
from tidewire.functions import names as N
from tidewire.functions import packet as P
from tidewire.functions.lookups import ARP_OPERATIONS, DHCP_MESSAGES, DNS_RCODES, DNS_TYPES, IP_PROTOCOLS, NTP_MODES, named

ARROW = " → "


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def hex_text(value: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(value.cast("long")), digits, "0"))


def _dns(m: Column) -> Column:
    opened = F.when(m["opcode"] == 0, "Standard query").otherwise(text("Query opcode ", m["opcode"]))
    query = F.concat(opened, F.array_join(F.transform(m["questions"], lambda q: text(" ", q["type_name"], " ", q["name"])), ""))
    said = F.transform(m["answers"], lambda a: text(" ", named(a["type"], DNS_TYPES, "TYPE%d"), " ", a["data"]))
    code = F.when(m["rcode"] == 0, "").otherwise(text(" ", named(m["rcode"], DNS_RCODES, "rcode %d")))
    first = F.get(m["questions"], F.lit(0))
    none = F.coalesce(F.when(F.size(said) == 0, text(" ", first["type_name"], " ", first["name"])), F.lit(""))
    more = F.when(F.size(said) > 3, text(" (+", F.size(said) - 3, " more)")).otherwise("")
    reply = F.concat(F.lit("Standard query response"), code, F.array_join(F.slice(said, 1, 3), ""), more, none)
    return F.concat(F.when(m["is_query"], query).otherwise(reply), F.when(m["valid"], "").otherwise(" [malformed]"))


def _http(h: Column) -> Column:
    request = F.concat(text(h["method"], " ", h["uri"]), F.when(h["host"] != "", text(" (Host: ", h["host"], ")")).otherwise(""))
    typed = F.when(h["content_type"] != "", text(" [", h["content_type"], "]")).otherwise("")
    body = F.when(h["body_size"] > 0, text(" (", h["body_size"], " bytes)")).otherwise("")
    return F.when(h["request"], request).otherwise(F.concat(text(h["version"], " ", h["status_code"], " ", h["reason"]), typed, body))


def _tls(t: Column) -> Column:
    name = lambda v: named(v, N.TLS_VERSIONS, "0x%04x")
    first = F.get(t["records"], F.lit(0))
    plain = text(named(first["content_type"], N.TLS_CONTENT, "type %d"), " (", name(first["version"]), ")")
    handshake = text(named(t["handshake_type"], N.TLS_HANDSHAKE, "Handshake type %d"), " (", name(first["version"]), ", ", t["handshake_length"], " bytes)")
    alert = text("Alert (level ", t["alert_level"], ", description ", t["alert"], ")")
    said = F.when((first["content_type"] == 22) & t["handshake_length"].isNotNull(), handshake).when((first["content_type"] == 21) & t["alert"].isNotNull(), alert).otherwise(plain)
    tail = (
        F.when(t["sni"] != "", text("Client Hello (SNI=", t["sni"], ")"))
        .when(t["handshake_type"] == 1, "Client Hello")
        .when(t["handshake_type"] == 2, "Server Hello")
        .when(F.size(t["records"]) == 1, said)
        .otherwise(text("(", F.size(t["records"]), " records)"))
    )
    return text(name(t["version"]), " ", tail)


def _dhcp(d: Column) -> Column:
    opened = F.when(d["opcode"] == 1, "BOOTP request").otherwise("BOOTP reply")
    kind = F.when(d["message_type"].isNotNull(), text(" - ", named(d["message_type"], DHCP_MESSAGES, "UNKNOWN"))).otherwise("")
    given = F.when(d["your_ip"] != "0.0.0.0", text(" yiaddr=", d["your_ip"])).otherwise("")
    client = F.when(d["client_mac"] != "00:00:00:00:00:00", text(" client=", d["client_mac"])).otherwise("")
    listed = F.when(F.size(d["options"]) > 0, text(" (", F.array_join(d["options"], "; "), ")")).otherwise("")
    return F.concat(opened, kind, text(" xid=0x", hex_text(d["transaction_id"], 8)), given, client, listed)


def application() -> Column:
    """The line of the application layer, NULL without one."""
    n = F.col("ntp")
    ntp = text("NTPv", n["version"], " ", named(n["mode"], NTP_MODES, "reserved"), " stratum=", n["stratum"])
    out = F.when(F.col("dns").isNotNull(), _dns(F.col("dns")))
    for name, line in (("dhcp", _dhcp(F.col("dhcp"))), ("ntp", ntp), ("http", _http(F.col("http"))), ("tls", _tls(F.col("tls")))):
        out = out.when(F.col(name).isNotNull(), line)
    return out


def arp(opcode: Column, sender: Column, target: Column, sender_mac: Column) -> Column:
    return (
        F.when(opcode == 1, text("Who has ", target, "? Tell ", sender))
        .when(opcode == 2, text(sender, " is at ", sender_mac))
        .when(opcode == 8, text("Gratuitous ARP for ", sender, " (", sender_mac, ")"))
        .otherwise(text("ARP ", named(opcode, ARP_OPERATIONS, "opcode %d")))
    )


def line() -> Column:
    """The line of the highest layer, with ``summary`` as that of the application; a malformed frame says why, a truncated one that it is."""
    a, i, t = F.col("arp"), F.col("icmp"), F.col("tcp")
    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    echo = i["type"].isin(0, 8) | (i["ipv6"] & i["type"].isin(128, 129))
    numbers = F.when(echo, text(" id=0x", hex_text(F.coalesce(i["id"], F.lit(0)), 4), " seq=", F.coalesce(i["sequence"], F.lit(0)))).otherwise("")
    ends = text(F.col("src_port"), ARROW, F.col("dst_port"))
    sizes = F.transform(F.filter(t["options"], lambda o: o["kind"] == 2), lambda o: text(" MSS=", o["value"]))
    wrong = F.when(~F.coalesce(t["checksum_valid"], F.lit(True)) & (t["checksum"] != 0), " [checksum invalid]").otherwise("")
    tcp = F.concat(text(ends, " [", P.flags_text(t["flags"]), "] Seq=", t["seq"], " Ack=", t["ack"], " Win=", t["window"], " Len=", size), F.array_join(sizes, ""), wrong)
    shown = F.when(size >= 2, text(" [", F.lower(F.hex(part(F.col("payload"), 0, 8))), "]")).otherwise("")
    cut = F.when(F.col("ipv4").isNotNull() & F.col("fragment"), text("fragment offset=", F.col("ipv4.fragment_offset"), " more=", F.when(F.col("ipv4.mf"), "yes").otherwise("no"))).otherwise("")
    network = F.concat(text(F.col("src_ip.text"), ARROW, F.col("dst_ip.text"), " ", named(F.col("ip_protocol"), IP_PROTOCOLS, "protocol %d")), cut)
    out = (
        F.when(a.isNotNull(), arp(a["opcode"], a["sender_ip"]["text"], a["target_ip"]["text"], a["sender_mac"]))
        .when(i.isNotNull(), F.concat(i["description"], numbers, text(" len=", size)))
        .when(F.col("summary").isNotNull(), F.col("summary"))
        .when(t.isNotNull(), tcp)
        .when(F.col("udp").isNotNull(), F.concat(ends, text(" Len=", size), shown))
        .when(F.col("src_ip").isNotNull(), network)
    )
    said = F.when(F.col("malformed"), text("[Malformed packet: ", F.col("reason"), "]")).otherwise(F.coalesce(out, F.lit("")))
    return F.concat(said, F.when(F.coalesce("truncated", F.lit(False)), " [truncated]").otherwise(""))
