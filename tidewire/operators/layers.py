"""Decoded packets as trees of text: a heading for each layer and indented lines under it.

The lines of a packet are one array of built-in expressions; ``tree_lines`` makes them rows,
so a report of many packets is never one string.  Texts are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.decode.info import hex_text, text
from tidewire.functions import ip as IP
from tidewire.functions import names as N
from tidewire.functions import packet as P
from tidewire.functions.lookups import ARP_OPERATIONS, DNS_RCODES, DNS_TYPES, IP_PROTOCOLS, VENDORS, named

ETHER_TYPES = {0x0800: "IPv4", 0x0806: "ARP", 0x86DD: "IPv6", 0x8100: "802.1Q VLAN", 0x88A8: "802.1ad QinQ", 0x88CC: "LLDP", 0x8864: "PPPoE session", 0x0842: "Wake-on-LAN"}
#: Bytes of a payload that are shown as text, and bytes of a hex dump.
PREVIEW, HEX_BYTES = 96, 256


def _if(condition: Column, *parts: Column | str) -> Column:
    """The text where the condition holds, else nothing."""
    return F.when(condition, text(*parts)).otherwise("")


def _line(condition: Column, *parts: Column | str) -> Column:
    """A line that is there only where the condition holds."""
    return F.when(condition, text(*parts))


def ether_type(code: Column) -> Column:
    return text(F.coalesce(named(code, ETHER_TYPES, None), F.lit("Unknown")), " (0x", hex_text(code, 4), ")")


def vendor_of(mac: Column) -> Column:
    """Vendor of a MAC address, NULL if its prefix is not in the table."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in VENDORS for x in pair]), F.substring(mac, 1, 8))


def _vendor(mac: Column) -> Column:
    found = vendor_of(mac)
    return F.when(found.isNotNull(), text(" (", found, ")")).otherwise("")


def _block(given: Column, heading: Column, *under: Column) -> Column:
    """A heading and the arrays of lines under it, without the lines that are not there; no lines without the layer."""
    none = F.array().cast("array<string>")
    lines = F.concat(*[F.coalesce(u, none) for u in under])
    return F.when(given, F.concat(F.array(heading), F.transform(F.array_compact(lines), lambda x: F.concat(F.lit("  "), x)))).otherwise(none)


def _checksum(layer: Column, zero: str) -> Column:
    told = F.when(layer["checksum"] == 0, zero).when(layer["checksum_valid"], " [valid]").otherwise(" [invalid]")
    return text("Checksum: 0x", hex_text(layer["checksum"], 4), told)


def _options(options: Column) -> Column:
    return F.transform(options, lambda o: text("Option: ", o["name"], _if(o["value"] != "", " = ", o["value"])))


def utc_time() -> Column:
    """The time of a packet as text."""
    return F.date_format(F.expr("timestampadd(MICROSECOND, ts_us, TIMESTAMP_NTZ'1970-01-01 00:00:00')"), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _frame() -> Column:
    c = F.col
    return _block(
        F.lit(True),
        text("Frame ", c("number"), ": ", F.octet_length("frame"), " bytes", _if(c("orig_len") != c("cap_len"), " (on wire: ", c("orig_len"), ")")),
        F.array(
            text("Arrival time: ", utc_time()),
            _line(F.coalesce(c("interface"), F.lit("")) != "", "Interface: ", c("interface")),
            text("Link type: ", N.link_name(c("link_type"))),
            text("Protocols: ", F.array_join("layers", ":")),
            text("Protocol: ", c("protocol")),
            text("Info: ", c("info")),
            _line(c("malformed"), "MALFORMED: ", c("reason")),
            _line(c("truncated"), "Frame is truncated"),
        ),
    )


def _link() -> list[Column]:
    s, e = F.col("sll"), F.col("eth")
    address = lambda side: text(e[side], _vendor(e[side]))
    tags = F.transform("vlans", lambda v: F.array(text("802.1Q VLAN tag, ID: ", v["id"], ", PRI: ", v["priority"]), text("  Inner EtherType: ", ether_type(v["inner_type"]))))
    return [
        _block(s.isNotNull(), F.lit("Linux cooked capture v1"), F.array(text("Packet type: ", s["packet_type"]), text("ARPHRD: ", s["hardware_type"]), text("EtherType: ", ether_type(s["ether_type"])))),
        _block(e.isNotNull(), text("Ethernet II, Src: ", e["src"], ", Dst: ", e["dst"]), F.array(text("Destination: ", address("dst")), text("Source: ", address("src")), text("Type: ", ether_type(e["ether_type"])))),
        F.flatten(F.coalesce(tags, F.array().cast("array<array<string>>"))),
    ]


def _network() -> list[Column]:
    a, four, six = F.col("arp"), F.col("ipv4"), F.col("ipv6")
    operation = named(a["opcode"], ARP_OPERATIONS, "opcode %d")
    local = lambda ip: text(ip["text"], _if(IP.is_private(ip["key"]), " (private)"))
    protocol = lambda code: named(code, IP_PROTOCOLS, "protocol %d")
    return [
        _block(
            a.isNotNull(),
            text("Address Resolution Protocol (", operation, ")"),
            F.array(
                text("Hardware type: ", a["hardware_type"], " (Ethernet)"),
                text("Protocol type: ", ether_type(a["protocol_type"])),
                text("Opcode: ", a["opcode"], " (", operation, ")"),
                text("Sender MAC: ", a["sender_mac"], _vendor(a["sender_mac"])),
                text("Sender IP: ", a["sender_ip"]["text"]),
                text("Target MAC: ", a["target_mac"]),
                text("Target IP: ", a["target_ip"]["text"]),
            ),
        ),
        _block(
            four.isNotNull(),
            text("Internet Protocol Version 4, Src: ", four["src"]["text"], ", Dst: ", four["dst"]["text"]),
            F.array(
                F.lit("Version: 4"),
                text("Header length: ", four["header_length"], " bytes"),
                text("DSCP: ", F.shiftright(four["tos"], 2), ", ECN: ", four["tos"].bitwiseAND(F.lit(3))),
                text("Total length: ", four["total_length"]),
                text("Identification: 0x", hex_text(four["identification"], 4)),
                text("Flags: ", F.when(four["df"], "0x40 Don't fragment").otherwise("0x00"), _if(four["mf"], ", 0x20 More fragments")),
                text("Fragment offset: ", four["fragment_offset"]),
                text("Time to live: ", four["ttl"]),
                text("Protocol: ", protocol(four["protocol"]), " (", four["protocol"], ")"),
                text("Header checksum: 0x", hex_text(four["checksum"], 4), F.when(four["checksum_valid"], " [valid]").otherwise(" [invalid]")),
                text("Source: ", local(four["src"])),
                text("Destination: ", local(four["dst"])),
            ),
            _options(four["options"]),
        ),
        _block(
            six.isNotNull(),
            text("Internet Protocol Version 6, Src: ", six["src"]["text"], ", Dst: ", six["dst"]["text"]),
            F.array(
                text("Traffic class: ", six["traffic_class"]),
                text("Flow label: 0x", hex_text(six["flow_label"], 5)),
                text("Payload length: ", six["payload_length"]),
                text("Next header: ", protocol(six["next_header"])),
                text("Hop limit: ", six["hop_limit"]),
            ),
        ),
    ]


def _transport() -> list[Column]:
    i, t, u = F.col("icmp"), F.col("tcp"), F.col("udp")
    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    return [
        _block(
            i.isNotNull(),
            text(F.when(i["ipv6"], "ICMPv6: ").otherwise("Internet Control Message Protocol: "), i["description"]),
            F.array(
                text("Type: ", i["type"], ", Code: ", i["code"]),
                text("Checksum: ", F.when(i["checksum_valid"], "valid").otherwise("invalid/unverified")),
                _line(i["type"].isin(0, 8, 128, 129), "Identifier: 0x", hex_text(F.coalesce(i["id"], F.lit(0)), 4), ", Sequence: ", F.coalesce(i["sequence"], F.lit(0))),
                _line(size > 0, "Embedded data: ", size, " bytes"),
            ),
        ),
        _block(
            t.isNotNull(),
            text("Transmission Control Protocol, Src Port: ", t["src_port"], ", Dst Port: ", t["dst_port"], ", Seq: ", t["seq"]),
            F.array(
                text("Source port: ", t["src_port"]),
                text("Destination port: ", t["dst_port"]),
                text("Sequence number: ", t["seq"]),
                text("Acknowledgement number: ", t["ack"]),
                text("Header length: ", t["header_length"], " bytes"),
                text("Flags: 0x", hex_text(t["flags"], 3), " (", P.flags_text(t["flags"]), ")"),
                text("Window size: ", t["window"]),
                _checksum(t, " (zero - offloaded)"),
            ),
            _options(t["options"]),
        ),
        _block(u.isNotNull(), text("User Datagram Protocol, Src Port: ", u["src_port"], ", Dst Port: ", u["dst_port"]), F.array(text("Length: ", u["length"]), _checksum(u, " (zero - offloaded/IPv4)"))),
    ]


def _application() -> list[Column]:
    d, h, s = F.col("dns"), F.col("http"), F.col("tls")
    bit = lambda mask, said: _if(d["flags"].bitwiseAND(F.lit(mask)) != 0, said)
    kind = F.when(d["is_query"], "query").otherwise("response")
    records = lambda section, word: F.transform(d[section], lambda r: text(word, ": ", r["name"], " ", named(r["type"], DNS_TYPES, "TYPE%d"), " ", r["data"]))
    version = lambda v: named(v, N.TLS_VERSIONS, "0x%04x")
    request = h["request"]

    def record(r: Column, k: Column) -> Column:
        # the type of a handshake and an alert are known of the first record of their kind
        plain = text(named(r["content_type"], N.TLS_CONTENT, "type %d"), " (", version(r["version"]), ")")
        before = lambda code: F.exists(F.slice(s["records"], F.lit(1), k), lambda x: x["content_type"] == code)
        shake = text(named(s["handshake_type"], N.TLS_HANDSHAKE, "Handshake type %d"), " (", version(r["version"]), ", ", s["handshake_length"], " bytes)")
        alert = text("Alert (level ", s["alert_level"], ", description ", s["alert"], ")")
        said = F.when((r["content_type"] == 22) & s["handshake_length"].isNotNull() & ~before(22), shake).when((r["content_type"] == 21) & s["alert"].isNotNull() & ~before(21), alert).otherwise(plain)
        return text(said, " (", r["length"], " bytes)")

    return [
        _block(
            d.isNotNull(),
            text("Domain Name System (", kind, ")"),
            F.array(
                text("Transaction ID: 0x", hex_text(d["id"], 4)),
                text("Flags: ", kind, bit(0x400, ", authoritative"), bit(0x200, ", truncated"), bit(0x100, ", RD"), bit(0x80, ", RA")),
                _line(~d["is_query"], "Reply code: ", named(d["rcode"], DNS_RCODES, "rcode %d")),
            ),
            F.transform(d["questions"], lambda q: text("Query: ", q["name"], " type ", q["type_name"])),
            records("answers", "Answer"),
            records("authority", "Authority"),
            records("additional", "Additional"),
        ),
        _block(F.col("dhcp").isNotNull(), F.lit("Dynamic Host Configuration Protocol"), F.array(F.col("summary"), text("Client MAC: ", F.col("dhcp.client_mac")), text("Transaction ID: 0x", hex_text(F.col("dhcp.transaction_id"), 8)))),
        _block(F.col("ntp").isNotNull(), F.lit("Network Time Protocol"), F.array(F.col("summary"))),
        _block(
            h.isNotNull(),
            F.when(request, "Hypertext Transfer Protocol (request)").otherwise("Hypertext Transfer Protocol (response)"),
            F.array(
                _line(request, "Request method: ", h["method"]),
                _line(request, "Request URI: ", h["uri"]),
                _line(~request, "Status code: ", h["status_code"], " ", h["reason"]),
                text("Request version: ", h["version"]),
            ),
            F.transform(h["headers"], lambda x: text(x["name"], ": ", x["value"])),
            F.array(_line(h["body_size"] > 0, "Body: ", h["body_size"], " bytes")),
        ),
        _block(
            s.isNotNull(),
            F.lit("Transport Layer Security"),
            F.transform(s["records"], record),
            F.array(_line(s["sni"] != "", "Server Name Indication: ", s["sni"])),
            F.transform(s["cipher_suites"], lambda x: text("Cipher suite: ", x)),
        ),
    ]


def _bytes(hexed: bool) -> list[Column]:
    data, size = F.col("payload"), F.octet_length("payload")
    shown = F.regexp_replace(F.decode(F.substring(data, 1, PREVIEW), "ISO-8859-1"), r"[^\x20-\x7e]", ".")
    dump = lambda c: [N.hex_dump(c, HEX_BYTES)] if hexed else []
    out = [_block(F.coalesce(size, F.lit(0)) > 0, text("Payload (", size, " bytes)"), F.array(text("ASCII: ", shown)), *dump(data))]
    return out + ([_block(F.octet_length("frame") > 0, F.lit("Frame hex dump"), *dump(F.col("frame")))] if hexed else [])


def tree(packets: DataFrame, hexed: bool = False) -> DataFrame:
    """number and ``lines`` of each decoded packet: every layer in order, its payload and, if asked, hex dumps.

    Times are UTC.  A layer that a packet has not makes no lines.
    """
    parts = [_frame(), *_link(), *_network(), *_transport(), *_application(), *_bytes(hexed)]
    return packets.select("number", F.concat(*parts).alias("lines"))


def tree_lines(packets: DataFrame, hexed: bool = False) -> DataFrame:
    """number, position (from 0) and line of each packet's tree."""
    return tree(packets, hexed).select("number", F.posexplode("lines").alias("position", "line"))
