"""Replies of UDP services: what a port says when it answers a probe.

DNS answers are found by the batch walk of :mod:`tidewire.decode.dns`, on the replies of DNS
ports alone; everything else is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.decode.binary import latin, let, small
from tidewire.decode.dns import txt_answer
from tidewire.functions.text import cut, escaped
from tidewire.operators.signatures import apply_match, match_banner

#: Characters of a banner that are kept, of a signature's and of a description.
BANNER, MATCHED_BANNER, DESCRIPTION = 200, 220, 120
COLUMNS = ("service", "product", "version", "extra", "confidence", "banner")


def longest_printable(text: Column) -> Column:
    """The longest run of characters that can be printed, the first of equal ones; empty if there is none."""
    runs = F.split(text, r"[^\x20-\x7e]+")
    return F.aggregate(runs, F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best))


def _told(service: Column | str, product: Column | str = "", version: Column | str = "", extra: Column | str = "", confidence: Column | int = 7) -> Column:
    given = zip(COLUMNS, (service, product, version, extra, confidence))
    return F.struct(*[(F.lit(v) if isinstance(v, (str, int)) else v).alias(n) for n, v in given])


def _dns(port: Column, size: Column, txt: Column) -> Column:
    found = F.coalesce(txt, F.lit("")) != ""
    return _told(
        F.when(port == 5353, "mdns").otherwise("dns"),
        F.when(found, "BIND").otherwise(""),
        F.when(found, txt).otherwise(""),
        F.when(found, "version.bind TXT").otherwise(F.concat(size.cast("string"), F.lit(" byte DNS response"))),
        F.when(found, 9).otherwise(7),
    )


def _ntp(data: Column) -> Column:
    first = small(data, 0)
    number = lambda c: c.cast("string")
    mode, version = first.bitwiseAND(F.lit(7)), F.shiftright(first, 3).bitwiseAND(F.lit(7))
    return _told("ntp", "NTP", F.concat(F.lit("v"), number(version)), F.concat(F.lit("mode "), number(mode), F.lit(", stratum "), number(small(data, 1))), 8)


def _snmp(text: Column) -> Column:
    extra = let(longest_printable(text), lambda run: F.when(F.length(run) > 4, F.concat(F.lit("sysDescr: "), cut(run, DESCRIPTION))).otherwise(""))
    return _told("snmp", "SNMP agent", "", extra)


def _ssdp(text: Column) -> Column:
    lines = F.filter(F.split(text, r"\r?\n"), lambda line: F.contains(F.lower(line), F.lit("server:")))
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    return _told("upnp", F.trim(F.substring(first, F.instr(first, ":") + 1, F.length(first))))


def read_replies(ports: DataFrame) -> DataFrame:
    """Rows of port and ``reply`` (binary) with what the reply tells of the service behind the port.

    Adds state, service, product, version, extra, confidence and banner.  A port without a
    reply (NULL) is ``open|filtered`` and tells nothing.  What no rule reads by its port goes
    to the signatures.
    """
    data, port, text = F.col("reply"), F.col("port"), F.col("_text")
    is_dns = port.isin(53, 5353)
    size = F.octet_length(data)
    given = ports.select("*", latin(data).alias("_text"), txt_answer(F.when(is_dns, data)).alias("_txt"))
    matched = given.select("*", match_banner(text, port).alias("_match"))
    nothing = F.lit("")
    plain = apply_match(F.col("_match"), F.lit("udp"), nothing, nothing, nothing, nothing, F.lit(0))
    by_signature = F.struct(*[plain[n].alias(n) for n in COLUMNS[:-1]])
    is_ntp, is_snmp, is_ssdp = (port == 123) & (size >= 4), (port == 161) & (size > 2), (port == 1900) & text.startswith("HTTP/1.1 200")
    told = F.when(is_dns, _dns(port, size, F.col("_txt"))).when(is_ntp, _ntp(data)).when(is_snmp, _snmp(text)).when(is_ssdp, _ssdp(text)).otherwise(by_signature)
    by_rule = is_dns | is_ntp | is_snmp | is_ssdp
    banner = escaped(F.when(by_rule, cut(text, BANNER)).otherwise(cut(text, MATCHED_BANNER)))
    read = matched.select("*", F.when(data.isNotNull(), told).alias("_told"))
    empty = {n: F.coalesce(F.col(f"_told.{n}"), F.lit(0 if n == "confidence" else "")) for n in COLUMNS[:-1]}
    out = read.withColumns({"state": F.when(data.isNotNull(), "open").otherwise("open|filtered"), **empty, "banner": F.coalesce(banner, nothing)})
    return out.drop("_text", "_txt", "_match", "_told")
