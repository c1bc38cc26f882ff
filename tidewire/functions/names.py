"""Names of protocol numbers and states, and texts of services, templates and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.lookups import name_of

#: Spellings of a transport.
PROTO_SPELLINGS = {"tcp": ("tcp", "t", "6"), "udp": ("udp", "u", "17"), "icmp": ("icmp", "i", "1")}
#: States of a port, the most telling first.
PORT_STATES = ("open", "closed", "filtered", "open|filtered", "unfiltered", "unknown")
#: Link types of captures.
LINKS = {0: "NULL", 1: "EN10MB (Ethernet)", 9: "PPP", 108: "LOOP", 101: "RAW IP", 113: "LINUX_SLL", 228: "IPv4", 229: "IPv6", 255: "NONE", 276: "LINUX_SLL2"}
#: Names of layers by their tags.
LAYERS = {"eth": "Ethernet", "sll": "Linux cooked", "vlan": "802.1Q VLAN", "arp": "ARP", "ip": "IPv4", "ipv6": "IPv6", "icmp": "ICMP", "icmpv6": "ICMPv6", "tcp": "TCP", "udp": "UDP", "dns": "DNS", "dhcp": "DHCP", "http": "HTTP", "tls": "TLS", "ntp": "NTP", "data": "Data"}
#: TLS record and handshake types, versions, suites, alerts.
TLS_CONTENT = {20: "Change Cipher Spec", 21: "Alert", 22: "Handshake", 23: "Application Data", 24: "Heartbeat"}
TLS_HANDSHAKE = {0: "Hello Request", 1: "Client Hello", 2: "Server Hello", 4: "New Session Ticket", 8: "Encrypted Extensions", 11: "Certificate", 12: "Server Key Exchange", 13: "Certificate Request", 14: "Server Hello Done", 15: "Certificate Verify", 16: "Client Key Exchange", 20: "Finished", 21: "Certificate URL", 22: "Certificate Status"}
TLS_VERSIONS = {0x0002: "SSL 2.0", 0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}
TLS_SUITES = {
    0x1301: "TLS_AES_128_GCM_SHA256", 0x1302: "TLS_AES_256_GCM_SHA384", 0x1303: "TLS_CHACHA20_POLY1305_SHA256",
    0xC02B: "ECDHE-ECDSA-AES128-GCM-SHA256", 0xC02C: "ECDHE-ECDSA-AES256-GCM-SHA384", 0xC02F: "ECDHE-RSA-AES128-GCM-SHA256", 0xC030: "ECDHE-RSA-AES256-GCM-SHA384",
    0xC013: "ECDHE-RSA-AES128-CBC-SHA", 0xC014: "ECDHE-RSA-AES256-CBC-SHA", 0xC009: "ECDHE-ECDSA-AES128-CBC-SHA", 0xC00A: "ECDHE-ECDSA-AES256-CBC-SHA",
    0x002F: "RSA-AES128-SHA", 0x0035: "RSA-AES256-SHA", 0x003C: "RSA-AES128-SHA256", 0x003D: "RSA-AES256-SHA256",
    0x009C: "AES128-GCM-SHA256", 0x009D: "AES256-GCM-SHA384", 0x000A: "RSA-3DES-EDE-CBC-SHA", 0x00FF: "TLS_EMPTY_RENEGOTIATION_INFO_SCSV",
}
TLS_ALERTS = {
    0: "close_notify", 10: "unexpected_message", 20: "bad_record_mac", 40: "handshake_failure", 42: "bad_certificate", 43: "unsupported_certificate",
    44: "certificate_revoked", 45: "certificate_expired", 46: "certificate_unknown", 47: "illegal_parameter", 48: "unknown_ca", 49: "access_denied",
    50: "decode_error", 51: "decrypt_error", 70: "protocol_version", 71: "insufficient_security", 80: "internal_error", 86: "inappropriate_fallback",
    90: "user_canceled", 109: "missing_extension", 112: "unrecognized_name", 116: "certificate_required", 120: "no_application_protocol",
}


def parse_proto(text: Column, fallback: str | None = None) -> Column:
    """tcp, udp or icmp of a name, its initial or its number in any case; else ``fallback``."""
    given, out = F.lower(F.trim(text)), F.when(F.lit(False), F.lit(""))
    for name, spellings in PROTO_SPELLINGS.items():
        out = out.when(given.isin(*spellings), name)
    return out.otherwise(F.lit(fallback))


def parse_port_state(text: Column) -> Column:
    given = F.lower(text)
    return F.when(given == "openfiltered", "open|filtered").when(given.isin(*PORT_STATES), given).otherwise("unknown")


def port_state_rank(state: Column) -> Column:
    """Place in :data:`PORT_STATES`; states that are not in it come last."""
    at = F.array_position(F.array(*[F.lit(s) for s in PORT_STATES]), F.coalesce(state, F.lit("unknown")))
    return F.when(at > 0, at - 1).otherwise(len(PORT_STATES) - 1).cast("int")


def link_name(link: Column) -> Column:
    return name_of(link, LINKS, "UNKNOWN")


def tls_version(code: Column) -> Column:
    return name_of(code, TLS_VERSIONS, "0x%04x")


def tls_suite(code: Column) -> Column:
    return name_of(code, TLS_SUITES, "0x%04x")


def tls_alert(code: Column) -> Column:
    return name_of(code, TLS_ALERTS, "alert %d")


def tls_label(code: Column) -> Column:
    """The version as flows show it, NULL without one."""
    return F.when(code >= 0x0304, "TLS 1.3").when(code == 0x0303, "TLS 1.2").when(code > 0, "TLS 1.x/SSL")


def answers_text(answers: Column) -> Column:
    """The first four answers that are not empty, comma-joined."""
    return F.array_join(F.slice(F.filter(answers, lambda a: F.coalesce(a, F.lit("")) != ""), 1, 4), ", ")


def expand_template(template: Column, groups: Column) -> Column:
    """``$9`` to ``$1`` replaced, the first of each, by the group of that number (empty if it is missing), then trimmed."""

    def step(text: Column, k: Column) -> Column:
        at = F.call_function("instr", text, F.concat(F.lit("$"), k.cast("string")))
        value = F.coalesce(F.get(groups, k - 1), F.lit(""))
        return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), value, F.substring(text, at + 2, F.length(text)))).otherwise(text)

    return F.trim(F.aggregate(F.sequence(F.lit(9), F.lit(1), F.lit(-1)), template, step))


def looks_binary(data: Column) -> Column:
    """Whether less than 70 % of the first 128 bytes can be printed; no bytes are no binary."""
    head = F.decode(F.substring(data.cast("binary"), 1, 128), "ISO-8859-1")
    shown = F.length(F.regexp_replace(head, r"[^\t\r\n\x20-\x7e]", ""))
    return F.coalesce((F.length(head) > 0) & (F.floor(shown * 100 / F.greatest(F.length(head), F.lit(1))) < 70), F.lit(False))


def hex_dump(data: Column, most: int = 256) -> Column:
    """Lines of offset, sixteen bytes in two halves and their text, as an array; NULL for NULL."""
    given = F.substring(data, 1, most)
    rows = F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr("-1") + F.ceil(F.length(given) / 16)).cast("int"))

    def line(k: Column) -> Column:
        part = F.substring(given, k * 16 + 1, F.lit(16))
        spaced = F.rpad(F.regexp_replace(F.lower(F.hex(part)), "(..)", " $1"), 48, " ")
        text = F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7e]", ".")
        return F.concat(F.format_string("%08x", k * 16), F.lit("  "), F.substring(spaced, 1, 24), F.lit(" "), F.substring(spaced, 25, 24), F.lit("  |"), text, F.lit("|"))

    more = F.when(F.length(data) > most, F.array(F.format_string("... (%d more bytes)", F.length(data) - most))).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(data) == 0, F.array().cast("array<string>")).when(data.isNotNull(), F.concat(F.transform(rows, line), more))


def tls_service(port: Column) -> Column:
    """Service of a port that answers in TLS."""
    return F.when(port == 443, "https").when(port == 993, "imaps").when(port == 465, "smtps").otherwise("ssl/tls")


def filled(text: Column, width: int, right: bool = False) -> Column:
    """Blanks up to ``width``; longer text stays whole."""
    blanks = F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(text)))
    return F.concat(blanks, text) if right else F.concat(text, blanks)


def service_text(service: Column, product: Column, version: Column) -> Column:
    """Service, product and version, those that are there, with blanks between."""
    return F.array_join(F.filter(F.array(service, product, version), lambda t: F.coalesce(t, F.lit("")) != ""), " ")


def port_line(port: Column, proto: Column, state: Column, service: Column, product: Column, version: Column) -> Column:
    """One line of a host's table of ports."""
    head = F.concat(filled(F.concat(port.cast("string"), F.lit("/"), proto), 10), filled(state, 14), filled(service, 18))
    return F.concat(head, service_text(F.lit(""), product, version))


def netmask(prefix: Column) -> Column:
    """IPv4 netmask of a prefix length as a number; lengths outside 0 to 32 count as the nearest."""
    bits = F.lit(32) - F.least(F.lit(32), F.greatest(F.lit(0), prefix))
    return F.lit(4294967295) - (F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int")) - 1)


def netmask_prefix(mask: Column) -> Column:
    """Leading ones of a 32-bit netmask."""
    return F.length(F.regexp_extract(F.lpad(F.bin(mask), 32, "0"), "^1*", 0))
