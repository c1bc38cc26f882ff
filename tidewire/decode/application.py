"""Application payloads to structs: HTTP and NTP by built-ins, DNS, TLS and DHCP with an Arrow function each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.decode.batch import Bytes, listed, options, read_once
from tidewire.decode.binary import latin, let, mac, part, small, uint
from tidewire.decode.dns import messages as dns
from tidewire.decode.tls import segments as tls

__all__ = ["dhcp", "dhcp_fields", "dns", "http", "looks_like_http", "ntp", "tls"]

#: Request methods.
METHODS = (
    "GET", "POST", "HEAD", "PUT", "DELETE", "OPTIONS", "TRACE", "CONNECT", "PATCH", "PROPFIND", "PROPPATCH", "MKCOL",
    "COPY", "MOVE", "LOCK", "UNLOCK", "SUBSCRIBE", "NOTIFY", "PURGE", "SEARCH", "CHECKOUT", "MERGE", "REPORT", "MKACTIVITY",
)
_COOKIE = b"\x63\x82\x53\x63"


def looks_like_http(payload: Column) -> Column:
    """Whether the first bytes are a status line or a method of three to nine letters."""
    short = "|".join(m for m in METHODS if len(m) <= 9)
    return (F.octet_length(payload) >= 8) & latin(part(payload, 0, 16)).rlike(rf"^(HTTP/1\.|HTTP/2|({short}) )")


def is_http(payload: Column) -> Column:
    """Whether a first line is a request's or a status line."""
    opened = latin(payload).rlike(rf"^(({'|'.join(METHODS)}) |HTTP/[^ \n]* \d+( |\r?\n|$))")
    return F.coalesce((F.octet_length(payload) >= 8) & opened, F.lit(False))


def http(payload: Column) -> Column:
    """Start line, headers and size of the body of a request or response in one segment, else NULL.

    A later header of one name wins.  A head that does not end in the segment is read as far as it goes.
    """
    ends = lambda t: F.when(F.instr(t, "\r\n\r\n") > 0, "\r\n\r\n").when(F.instr(t, "\n\n") > 0, "\n\n").otherwise("")
    cut = lambda t, end: F.when(end == "\r\n\r\n", F.substring_index(t, "\r\n\r\n", 1)).when(end == "\n\n", F.substring_index(t, "\n\n", 1)).otherwise(t)

    def headed(t: Column) -> Column:
        return let(ends(t), lambda end: let(cut(t, end), lambda head: made(F.split(head, "\r?\n"), F.when(end != "", F.length(t) - F.length(head) - F.length(end)).otherwise(0))))

    def made(lines: Column, body_size: Column) -> Column:
        pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.btrim(F.substring(x, F.instr(x, ":") + 1, F.length(x)), F.lit(" \t\r")).alias("value"))
        pairs = lambda ls: F.transform(F.filter(F.slice(ls, 2, F.greatest(F.size(ls), F.lit(1))), lambda x: F.instr(x, ":") > 0), pair)
        return let(lines, lambda ls: let(F.split(F.get(ls, F.lit(0)), " "), lambda word: let(pairs(ls), lambda ps: read(word, ps, body_size))))

    def read(word: Column, pairs: Column, body_size: Column) -> Column:
        nth = lambda k: F.get(word, F.lit(k))
        response = nth(0).startswith("HTTP/") & F.coalesce(nth(1).rlike(r"^\d+$"), F.lit(False))
        request = nth(0).isin(*METHODS) & (F.size(word) >= 2)

        def header(*names: str) -> Column:
            return F.coalesce(F.try_element_at(F.filter(pairs, lambda p: F.lower(p["name"]).isin(*names)), F.lit(-1))["value"], F.lit(""))

        fields = F.struct(
            request.alias("request"),
            F.when(request, nth(0)).otherwise("").alias("method"),
            F.when(request, nth(1)).otherwise("").alias("uri"),
            F.when(request, F.coalesce(nth(2), F.lit("HTTP/1.0"))).otherwise(nth(0)).alias("version"),
            F.when(response, nth(1).try_cast("int")).otherwise(0).alias("status_code"),
            F.when(response, F.array_join(F.slice(word, 3, F.greatest(F.size(word), F.lit(1))), " ")).otherwise("").alias("reason"),
            header("host").alias("host"),
            header("user-agent").alias("user_agent"),
            header("content-type").alias("content_type"),
            header("server").alias("server"),
            header("cookie", "set-cookie").alias("cookie"),
            header("referer").alias("referer"),
            F.coalesce(header("content-length").try_cast("int"), F.lit(-1)).alias("content_length"),
            pairs.alias("headers"),
            body_size.cast("int").alias("body_size"),
        )
        return F.when(request | response, fields)

    return F.when(F.octet_length(payload) >= 8, let(latin(payload), headed))


def http_header(http: Column, name: str) -> Column:
    """Value of the first header of a name in any letter case, NULL without one."""
    return F.get(F.filter(http["headers"], lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def _ntp_first(payload: Column) -> tuple[Column, Column]:
    first = small(payload, 0)
    return F.shiftright(first, 3).bitwiseAND(F.lit(7)), first.bitwiseAND(F.lit(7))


def is_ntp(payload: Column) -> Column:
    version, mode = _ntp_first(payload)
    return F.coalesce((F.octet_length(payload) >= 48) & version.between(1, 4) & mode.between(1, 7), F.lit(False))


def ntp(payload: Column) -> Column:
    version, mode = _ntp_first(payload)
    return F.struct(version.alias("version"), mode.alias("mode"), small(payload, 1).alias("stratum"))


_OPTION = T.StructType([T.StructField(n, T.IntegerType()) for n in ("code", "at", "size")])


@read_once
@F.arrow_udf(T.ArrayType(_OPTION))
def dhcp(payloads: pa.Array) -> pa.Array:
    """Where the options of BOOTP messages with the DHCP cookie lie; NULL for any other payload."""
    source = Bytes(payloads)
    n = len(source)
    given = (source.size >= 240) & (source.uint(236, 4) == int.from_bytes(_COOKIE, "big"))
    row, *columns = options(source, np.full(n, 240), source.size, np.flatnonzero(given), 0, (0,), 255)
    listing = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns], [f.name for f in _OPTION])
    found = listed(row, n, listing)
    return pa.ListArray.from_arrays(found.offsets, found.values, mask=pa.array(~given))


def dhcp_fields(payload: Column, found: Column) -> Column:
    """Fixed fields and options 12, 50, 51, 53, 54 and 60; ``options`` are those as texts, in order."""

    def last(code: int, value, size: int | None = None) -> Column:
        fits = F.filter(found, lambda o: (o["code"] == code) & ((o["size"] == size) if size else (o["size"] > 0)))
        return F.try_element_at(F.transform(fits, value), F.lit(-1))

    ip = lambda at: F.concat_ws(".", *[small(payload, at + k).cast("string") for k in range(4)])
    letters = lambda o: latin(part(payload, o["at"], o["size"]))
    from tidewire.functions.lookups import DHCP_MESSAGES, named

    def line(o: Column) -> Column:
        four = o["size"] == 4
        return (
            F.when((o["code"] == 53) & (o["size"] > 0), F.concat(F.lit("Message-Type: "), named(small(payload, o["at"]), DHCP_MESSAGES, "UNKNOWN")))
            .when((o["code"] == 50) & four, F.concat(F.lit("Requested-IP: "), ip(o["at"])))
            .when((o["code"] == 54) & four, F.concat(F.lit("Server-ID: "), ip(o["at"])))
            .when(o["code"] == 12, F.concat(F.lit("Hostname: "), letters(o)))
            .when(o["code"] == 60, F.concat(F.lit("Vendor-Class: "), letters(o)))
            .when((o["code"] == 51) & four, F.concat(F.lit("Lease-Time: "), uint(payload, o["at"], 4).cast("string"), F.lit("s")))
        )

    kinds = F.transform(F.filter(found, lambda o: (o["code"] == 53) & (o["size"] > 0)), lambda o: small(payload, o["at"]))
    made = F.struct(
        small(payload, 0).alias("opcode"),
        uint(payload, 4, 4).alias("transaction_id"),
        F.get(kinds, F.lit(0)).alias("message_type"),
        F.when(small(payload, 2).between(1, 6), mac(payload, 28)).otherwise("00:00:00:00:00:00").alias("client_mac"),
        ip(F.lit(12)).alias("client_ip"),
        ip(F.lit(16)).alias("your_ip"),
        ip(F.lit(20)).alias("server_ip"),
        ip(F.lit(24)).alias("relay_ip"),
        F.coalesce(last(12, letters), F.lit("")).alias("hostname"),
        F.coalesce(last(50, lambda o: ip(o["at"]), 4), F.lit("")).alias("requested_ip"),
        last(51, lambda o: uint(payload, o["at"], 4), 4).alias("lease_seconds"),
        F.coalesce(last(54, lambda o: ip(o["at"]), 4), F.lit("")).alias("server_id"),
        F.coalesce(last(60, letters), F.lit("")).alias("vendor_class"),
        F.filter(F.transform(found, line), lambda x: x.isNotNull()).alias("options"),
    )
    return F.when(found.isNotNull(), made)
