"""Text tables of a host: IPv4 and IPv6 routes, neighbours, the default gateway."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.names import netmask_prefix

#: Route flags and their letters.
ROUTE_FLAGS = ((0x1, "U"), (0x2, "G"), (0x4, "H"), (0x8, "R"), (0x10, "D"), (0x20, "M"))
ROUTE_ORDER = (F.desc, "is_default"), (F.desc, "prefix"), (F.asc, "metric"), (F.asc, "destination"), (F.asc, "interface")


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))


def _number(text: Column) -> Column:
    """A decimal or 0x number."""
    return F.when(text.rlike("^0[xX]"), F.conv(F.substring(text, 3, 16), 16, 10).try_cast("int")).otherwise(text.try_cast("int"))


def _word_order(hexadecimal: Column, text: bool) -> Column:
    """An IPv4 word whose bytes are written last first: dotted text, or a number."""
    octets = [F.conv(F.substring(hexadecimal, at, 2), 16, 10) for at in (7, 5, 3, 1)]
    if text:
        return F.concat_ws(".", *octets)
    return sum((o.cast("long") * (256 ** (3 - k)) for k, o in enumerate(octets)), F.lit(0))


def _ordered(routes: DataFrame) -> DataFrame:
    """The default first, then longer prefixes, then smaller metrics."""
    return routes.orderBy(*[way(c) for way, c in ROUTE_ORDER])


def routes(spark: SparkSession, path: str) -> DataFrame:
    """IPv4 routes of a kernel table of hexadecimal words; the heading and short lines are left out."""
    f = lambda k: F.get("f", F.lit(k))
    rows = _fields(spark, path).where((F.size("f") >= 8) & f(1).rlike("^[0-9A-Fa-f]{8}$") & f(2).rlike("^[0-9A-Fa-f]{8}$") & f(7).rlike("^[0-9A-Fa-f]{8}$"))
    bits = F.conv(f(3), 16, 10).cast("int")
    letters = F.concat(*[F.when(bits.bitwiseAND(F.lit(b)) != 0, name).otherwise("") for b, name in ROUTE_FLAGS])
    named = rows.select(
        f(0).alias("interface"), _word_order(f(1), True).alias("destination"), netmask_prefix(_word_order(f(7), False)).alias("prefix"),
        _word_order(f(2), True).alias("gateway"), _number(f(6)).alias("metric"), letters.alias("flags"),
    )
    return _ordered(named.withColumn("is_default", (F.col("prefix") == 0) & (F.col("destination") == "0.0.0.0")))


def routes6(spark: SparkSession, path: str) -> DataFrame:
    """IPv6 routes with addresses as keys of 34 characters (see :mod:`tidewire.functions.ip`)."""
    f = lambda k: F.get("f", F.lit(k))
    rows = _fields(spark, path).where((F.size("f") >= 10) & f(0).rlike("^[0-9A-Fa-f]{32}$") & f(4).rlike("^[0-9A-Fa-f]{32}$"))
    number = lambda c: F.conv(c, 16, 10).cast("long")
    key = lambda c: F.concat(F.lit("06"), F.lower(c))
    named = rows.select(f(9).alias("interface"), key(f(0)).alias("destination"), number(f(1)).cast("int").alias("prefix"), key(f(4)).alias("gateway"), number(f(5)).alias("metric"))
    return _ordered(named.withColumn("is_default", F.col("prefix") == 0))


def neighbours(spark: SparkSession, path: str) -> DataFrame:
    """Neighbours of an IPv4 kernel table; a MAC of zeros is none."""
    f = lambda k: F.get("f", F.lit(k))
    flags = _number(f(2))
    has = lambda b: flags.bitwiseAND(F.lit(b)) != 0
    state = F.when(has(2), "complete").when(has(4), "permanent").when(has(8), "published").otherwise("incomplete")
    mac = F.when(f(3).rlike("^([0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$") & (f(3) != "00:00:00:00:00:00"), F.lower(f(3)))
    rows = _fields(spark, path).where((F.size("f") >= 6) & f(0).rlike(r"^\d{1,3}(\.\d{1,3}){3}$"))
    return rows.select(f(0).alias("address"), mac.alias("mac"), f(5).alias("interface"), state.alias("state"))


def neighbours6(spark: SparkSession, path: str) -> DataFrame:
    """Neighbours listed as ``address dev NAME lladdr MAC STATE``; four words at least."""
    rows = _fields(spark, path).where((F.size("f") >= 4) & F.get("f", F.lit(0)).contains(":"))
    after = lambda word: F.get("f", F.array_position("f", F.lit(word)).cast("int"))
    named = lambda word: F.when(F.array_contains("f", word), after(word))
    return rows.select(F.get("f", F.lit(0)).alias("address"), named("lladdr").alias("mac"), named("dev").alias("interface"), F.element_at("f", -1).alias("state"))


def default_gateway(routes: DataFrame, interface: str | None = None) -> DataFrame:
    """At most one row: the gateway of the first default route that has one."""
    fit = routes.where("is_default and gateway <> '0.0.0.0'")
    fit = fit if interface is None else fit.where(F.col("interface") == interface)
    return _ordered(fit).limit(1).select("gateway", "interface")
