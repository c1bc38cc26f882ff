"""Text columns: sizes, durations, hex, URLs, port lists, escaping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def human_bytes(n: Column) -> Column:
    """1023 B, 1.00 KB, 2.50 MB, ..."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        value = F.format_string(f"%.2f {unit}", n / F.lit(float(1024**power)))
        out = out.otherwise(value) if unit == "TB" else out.when(n < 1024 ** (power + 1), value)
    return out


def parse_size(text: Column) -> Column:
    """Bytes of 512, 10K, 1.5M, 2G (powers of 1024), NULL if it is none."""
    number = F.regexp_extract(text, r"(?i)^\s*(\d+(?:\.\d+)?)\s*([kmgt]?)i?b?\s*$", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, r"(?i)^\s*(\d+(?:\.\d+)?)\s*([kmgt]?)i?b?\s*$", 2))
    factor = F.when(unit == "k", 2.0**10).when(unit == "m", 2.0**20).when(unit == "g", 2.0**30).when(unit == "t", 2.0**40).otherwise(1.0)
    return F.floor(number * factor).cast("long")


def parse_duration(text: Column) -> Column:
    """Microseconds of 10us, 5ms, 2s, 1.5m, 1h; a bare number is seconds."""
    pattern = r"(?i)^\s*(\d+(?:\.\d+)?)\s*(us|ms|s|m|h)?\s*$"
    number, unit = F.regexp_extract(text, pattern, 1).try_cast("double"), F.lower(F.regexp_extract(text, pattern, 2))
    factor = F.when(unit == "us", 1.0).when(unit == "ms", 1e3).when(unit == "m", 6e7).when(unit == "h", 3.6e9).otherwise(1e6)
    return F.floor(number * factor).cast("long")


def hex_bytes(text: Column) -> Column:
    """Bytes of hexadecimal text; colons, dashes, blanks and commas are passed over, an odd digit count is NULL."""
    digits = F.regexp_replace(text, "[:, -]", "")
    return F.when(digits.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(digits))


def ascii_preview(data: Column, most: int = 64) -> Column:
    """Bytes as text, one character each, what cannot be printed as a dot."""
    return F.regexp_replace(F.decode(F.substring(data, 1, most), "ISO-8859-1"), r"[^\x20-\x7e]", ".")


def truncate(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def cut(text: Column, width: int) -> Column:
    """At most ``width`` characters, the last three of a longer text as dots."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def escaped(text: Column) -> Column:
    """Backslashes, quotes and control characters as escapes of a string literal."""
    out = F.regexp_replace(text, r'([\\"])', r"\\$1")
    for plain, sign in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        out = F.replace(out, F.lit(plain), F.lit("\\" + sign))
    for code in (*range(9), 11, 12, *range(14, 32), 127):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    return out


def url_path(uri: Column) -> Column:
    return F.substring_index(uri, "?", 1)


def query_value(uri: Column, name: str) -> Column:
    """A parameter of the query string, decoded; empty if it is not there."""
    raw = F.regexp_extract(uri, rf"[?&]{name}=([^&]*)", 1)
    return F.try_url_decode(raw)


def csv_text(value: Column) -> Column:
    """A CSV cell: control characters but tabs go, quotes are doubled, and it is quoted where it must be."""
    clean = F.regexp_replace(value, r"[\x00-\x08\x0a-\x1f]", "")
    return F.when(value.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(clean, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(clean)


def xml_text(value: Column) -> Column:
    out = value
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "?")


def compact_ports(df: DataFrame, keys: list[str], port: str = "port") -> DataFrame:
    """Ports of each group as text with runs, such as ``22,80-82``; at most 65535 ports make a group."""
    order = Window.partitionBy(*keys).orderBy(port)
    runs = df.select(*keys, port).distinct().withColumn("_run", F.col(port) - F.row_number().over(order)).groupBy(*keys, "_run").agg(F.min(port).alias("_lo"), F.max(port).alias("_hi"))
    text = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo").cast("string")).otherwise(F.concat(F.col("_lo").cast("string"), F.lit("-"), F.col("_hi").cast("string")))
    listed = F.array_sort(F.collect_list(F.struct(F.col("_lo"), text.alias("text"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["text"]), ",").alias("ports"))


#: Where the 64-bit hash of Fowler, Noll and Vo starts here, and its prime.
FNV_START, FNV_PRIME = 1469598103934665603, 1099511628211


@F.arrow_udf(T.LongType())
def fnv1a64(data: pa.Array) -> pa.Array:
    """The hash of bytes, all rows of a batch byte by byte; as a signed number. NULL of NULL."""
    from tidewire.decode.batch import Bytes

    source = Bytes(data)
    out = np.full(len(source), FNV_START, dtype=np.uint64)
    # the longest rows first, so that those that are still being read are a prefix
    order = np.argsort(-source.size, kind="stable")
    sizes, begin = source.size[order], source.begin[order]
    for k in range(int(sizes.max(initial=0))):
        live = order[: int(np.searchsorted(-sizes, -k, side="left"))]
        out[live] = (out[live] ^ source.data[begin[: len(live)] + k].astype(np.uint64)) * np.uint64(FNV_PRIME)
    return pa.array(out.view(np.int64), mask=~source.given)
