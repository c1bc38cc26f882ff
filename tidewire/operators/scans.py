"""Scan observations: expansion of targets, merging of probe results, matching of banners."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.ip import ipv4_number, ipv4_text, number_key
from tidewire.functions.lookups import service_name
from tidewire.functions.names import port_state_rank

#: Addresses of a block that a range is cut into.
BLOCK = 4096


def parse_targets(text: str) -> list[tuple[int, int]]:
    """IPv4 ranges (first, last) of a list of addresses, networks, and dashed ranges."""
    out = []
    for token in text.replace(",", " ").replace(";", " ").split():
        if "/" in token:
            net = ipaddress.IPv4Network(token, strict=False)
            out.append((int(net.network_address), int(net.broadcast_address)))
        elif "-" in token:
            first, last = token.split("-", 1)
            low = ipaddress.IPv4Address(first)
            high = ipaddress.IPv4Address(last if "." in last else f"{first.rsplit('.', 1)[0]}.{last}")
            if high < low:
                raise ValueError(f"range ends before it starts: {token}")
            out.append((int(low), int(high)))
        elif "*" in token or "x" in token:
            parts = [None if p in ("*", "x") else int(p) for p in token.split(".")]
            # octets that are free at the end are one range; each free one before them adds a range for each of its values
            free = next((k for k, p in enumerate(reversed(parts)) if p is not None), len(parts))
            heads = [0]
            for p in parts[: len(parts) - free]:
                heads = [h * 256 + v for h in heads for v in (range(256) if p is None else [p])]
            out += [(h << 8 * free, ((h + 1) << 8 * free) - 1) for h in heads]
        else:
            out.append((int(ipaddress.IPv4Address(token)),) * 2)
    return out


def expand_targets(spark: SparkSession, text: str, limit: int | None = None) -> DataFrame:
    """(address, key) of every address of a target list, once, in order of address."""
    ranges = spark.createDataFrame(parse_targets(text), "low long, high long")
    # long ranges are cut into blocks first, so no row ever holds a whole network
    blocks = ranges.select(F.explode(F.sequence("low", "high", F.lit(BLOCK).cast("long"))).alias("low"), "high").repartition("low")
    numbers = blocks.select(F.explode(F.sequence("low", F.least("high", F.col("low") + (BLOCK - 1)))).alias("n")).distinct()
    keyed = numbers.select(number_key(F.col("n")).alias("key"))
    out = keyed.select(ipv4_text(F.col("key")).alias("address"), "key")
    return out if limit is None else out.orderBy("key").limit(limit)


def without(targets: DataFrame, spark: SparkSession, excluded: str) -> DataFrame:
    """Targets outside the excluded ranges: a range anti-join with the (small, given) list of ranges."""
    ranges = spark.createDataFrame(parse_targets(excluded), "low long, high long")
    n = ipv4_number(targets["key"])
    return targets.join(F.broadcast(ranges), n.between(ranges["low"], ranges["high"]), "left_anti")


def parse_ports(text: str) -> list[tuple[int, int]]:
    out = []
    for token in filter(None, (t.strip() for t in text.split(","))):
        token = token[2:] if token[:2].upper() in ("T:", "U:") else token
        low, high = ("1", "65535") if token in ("-", "all") else (token.split("-", 1) if "-" in token else (token, token))
        if not (low.isdigit() and high.isdigit()) or not 1 <= int(low) <= int(high) <= 65535:
            raise ValueError(f"no port specification: {token}")
        out.append((int(low), int(high)))
    return out


def expand_ports(spark: SparkSession, text: str) -> DataFrame:
    """Every port of a list such as ``22,80,8000-8010``, once, in order."""
    ranges = spark.createDataFrame(parse_ports(text), "low int, high int")
    return ranges.select(F.explode(F.sequence("low", "high")).alias("port")).distinct().orderBy("port")


def probe_plan(targets: DataFrame, ports: DataFrame) -> DataFrame:
    """Every target with every port: the product is the job, and at most 65535 ports are broadcast."""
    return targets.select("address").crossJoin(F.broadcast(ports))


def port_state(reply: Column, flags: Column) -> Column:
    """State of a port from a raw reply: SYN+ACK open, RST closed, another ACK unfiltered, silence filtered."""
    bit = lambda b: flags.bitwiseAND(F.lit(b)) != 0
    return F.when(~reply, "filtered").when(bit(2) & bit(16), "open").when(bit(4), "closed").when(bit(16), "unfiltered").otherwise("filtered")


def port_results(probes: DataFrame) -> DataFrame:
    """One row for each port: open beats anything else, otherwise the first state; the first banner, that of an open reply first."""
    has = F.col("banner") != ""
    first = lambda value, given: F.min_by(value, F.when(given, F.col("seq")))
    open_ = F.col("state") == "open"
    return probes.groupBy("scan_id", "address", "proto", "port").agg(
        F.when(F.count_if(open_) > 0, "open").otherwise(F.min_by("state", "seq")).alias("state"),
        F.coalesce(first(F.col("banner"), has & open_), first(F.col("banner"), has), F.lit("")).alias("banner"),
        F.count(F.lit(1)).alias("probes"),
    )


#: Texts of a port that a later result may fill.
FILLABLE = ("banner", "product", "version", "extra_info")


def finalize(results: DataFrame) -> DataFrame:
    """One row for each port of a scan's host, from any number of results with ``seq``.

    The most telling state stands (see ``PORT_STATES``).  Texts that are empty and numbers that
    are zero are filled from the other results in the order of state and ``seq``; the highest
    confidence counts.  A port without a service gets the name of its number.
    """
    order = F.struct(port_state_rank(F.col("state")).alias("rank"), F.col("seq"))
    first = lambda c, given: F.min_by(F.col(c), F.when(given, order))
    merged = results.groupBy("scan_id", "address", "proto", "port").agg(
        F.min_by("state", order).alias("state"),
        F.coalesce(F.min_by("service", order), F.lit("")).alias("_service"),
        *[F.coalesce(first(c, F.col(c) != ""), F.lit("")).alias(c) for c in FILLABLE],
        *[F.coalesce(first(c, F.col(c) != 0), F.lit(0)).alias(c) for c in ("rtt_us", "ttl", "tcp_window")],
        F.coalesce(F.max("confidence"), F.lit(0)).alias("confidence"),
    )
    named = service_name(merged)
    return named.withColumn("service", F.when(F.col("_service") != "", F.col("_service")).otherwise(F.col("service"))).drop("_service")


def host_systems(hosts: DataFrame, ports: DataFrame) -> DataFrame:
    """Hosts with ``os_guess``: by their TTL and the window of their first TCP port that has one."""
    windows = ports.where("proto = 'tcp' and tcp_window <> 0").groupBy("scan_id", "address").agg(F.min_by("tcp_window", "port").alias("_window"))
    guessed = hosts.join(windows, ["scan_id", "address"], "left")
    guess = os_guess(F.col("ttl"), F.coalesce("_window", F.lit(0)))
    return guessed.withColumn("os_guess", F.when(F.col("ttl") > 0, guess).otherwise("")).drop("_window")


def host_results(probes: DataFrame) -> DataFrame:
    """One row for each host: first round-trip time, first TTL and first TCP window that are there."""
    first = lambda c, given: F.min_by(F.col(c), F.when(given, F.col("seq")))
    return probes.groupBy("scan_id", "address").agg(
        (F.count(F.lit(1)) > 0).alias("up"),
        F.min_by("rtt_us", "seq").alias("latency_us"),
        first("ttl", F.col("ttl") > 0).alias("ttl"),
        first("tcp_window", F.col("tcp_window") > 0).alias("tcp_window"),
    )


def counts(ports: DataFrame) -> DataFrame:
    state = F.col("state")
    return ports.agg(
        F.count_distinct(F.when(state == "open", F.col("address"))).alias("hosts_with_open_ports"),
        F.count_if(state == "open").alias("open"),
        F.count_if(state == "closed").alias("closed"),
        F.count_if(state.isin("filtered", "open|filtered")).alias("filtered"),
    )


def open_port_histogram(ports: DataFrame) -> DataFrame:
    return ports.where("state = 'open'").groupBy("port").agg(F.count_distinct("address").alias("hosts"))


def inventory(ports: DataFrame) -> DataFrame:
    """Hosts with their open ports as text; a host has at most 131070 of them."""
    listed = F.array_sort(F.collect_list(F.struct("port", "proto")))
    text = F.array_join(F.transform(listed, lambda p: F.concat(p["port"].cast("string"), F.lit("/"), p["proto"])), ",")
    return ports.where("state = 'open'").groupBy("address").agg(text.alias("open_ports"))


#: Systems by the TCP window that a packet came with.
OS_WINDOWS = {8192: "Windows XP/2003", 16384: "Windows Vista/7/2008", 65535: "macOS/BSD or older Windows", 5840: "Linux 2.6+", 14600: "Linux 3.x+/4.x+", 64240: "Linux 5.x+ or Windows 10+", 4128: "Cisco IOS"}


def os_guess(ttl: Column, window: Column, dont_fragment: Column | None = None) -> Column:
    """A coarse system from TTL and TCP window; with a TTL of 255 and no fragments allowed, a network device."""
    by_ttl = F.when(ttl <= 32, "Windows (TTL <= 32)").when(ttl <= 64, "Linux/Unix/macOS (TTL <= 64)").when(ttl <= 128, "Windows (TTL <= 128)").otherwise("Network device / Solaris (TTL > 128)")
    out = F.when(F.coalesce(dont_fragment if dont_fragment is not None else F.lit(False), F.lit(False)) & (ttl == 255), "Network device (router/switch/firewall)")
    for size, name in OS_WINDOWS.items():
        out = out.when(window == size, name)
    return F.when(F.coalesce(ttl, F.lit(0)) == 0, "unknown").otherwise(out.otherwise(by_ttl))


def merge_attributes(results: DataFrame, keys: list[str], attributes: list[str], order: str) -> DataFrame:
    """For each key, every attribute from the first row that has it (NULL and empty count as missing)."""
    filled = lambda c: F.min_by(F.col(c), F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(order)))
    return results.groupBy(*keys).agg(*[filled(c).alias(c) for c in attributes])


def smoothed_rtt(probes: DataFrame, key: str = "address") -> DataFrame:
    """Exponentially weighted round-trip time of each host, in probe order: 0.7 old, 0.3 new.

    The weights of a geometric fold are closed-form, so this is a window and a sum.
    """
    order = Window.partitionBy(key).orderBy("seq")
    from_end = F.count(F.lit(1)).over(Window.partitionBy(key)) - F.row_number().over(order)
    at = F.row_number().over(order)
    weight = F.when(at == 1, F.pow(F.lit(0.7), from_end)).otherwise(0.3 * F.pow(F.lit(0.7), from_end))
    return probes.select(key, (F.col("rtt_us") * weight).alias("part")).groupBy(key).agg(F.sum("part").alias("rtt_us"))

