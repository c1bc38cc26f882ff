"""Fixed tables over the test tables: every service, vendor and popular port meets a row; raw frames and broken ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.decode.frames import decode, to_logical
from tidewire.filters.fields import logical as field
from tidewire.functions.lookups import SERVICES, TOP_TCP, TOP_UDP, VENDORS, service_name, top_ports, vendor_name
from tidewire.functions.text import fnv1a64
from tidewire.operators import stats
from tidewire.plans.bridge import PACKETS_CTE, packets
from tidewire.plans.frames import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _pick(values: list, k: str = "number"):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(k) % len(values)).cast("int") + 1)


def _rows(values) -> str:
    return "(values " + ", ".join(str(tuple(v)) for v in values) + ")"


def _vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix, and one that nobody has."""
    prefixes = [p for p, _ in VENDORS] + ["02:aa:bb"]
    return vendor_name(packets(spark, sf_dir).select("number", F.concat(_pick(prefixes), F.lit(":00:00:01")).alias("mac")))


QUERIES["vendor_names"] = _vendors
ORACLES["vendor_names"] = f"{PACKETS_CTE} select number, prefix || ':00:00:01' as mac, vendor from packets join {_rows((i, p, v) for i, (p, v) in enumerate((*VENDORS, ('02:aa:bb', ''))))} t(i, prefix, name) on number % {len(VENDORS) + 1} = i, lateral (select nullif(name, '') as vendor)"


def _services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every port of the table under both protocols."""
    ports = sorted({p for p, _, _ in SERVICES})
    asked = packets(spark, sf_dir).select("number", _pick(ports).alias("port"), F.explode(F.array(F.lit("tcp"), F.lit("udp"))).alias("proto"))
    return service_name(asked)


_PORTS = sorted({p for p, _, _ in SERVICES})
QUERIES["service_names"] = _services
ORACLES["service_names"] = f"""{PACKETS_CTE} select number, a.port, a.proto, coalesce(service, 'unknown') as service from (select number, port, unnest(['tcp', 'udp']) as proto from packets join {_rows(enumerate(_PORTS))} t(i, port) on number % {len(_PORTS)} = i) a
  left join {_rows(SERVICES)} s(port, proto, service) on a.port = s.port and a.proto = s.proto"""


def _popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets to popular ports by rank; the ports of both lists are tried on every protocol."""
    ports = sorted({*TOP_TCP, *TOP_UDP})
    seen = packets(spark, sf_dir).select(_pick(ports).alias("port"))
    of = lambda proto, n: seen.join(F.broadcast(top_ports(spark, proto, n)), "port").withColumns({"proto": F.lit(proto), "asked": F.lit(n)})
    return of("tcp", 0).union(of("tcp", 100)).union(of("udp", 0)).union(of("udp", 7)).groupBy("proto", "asked", "rank", "port").agg(F.count(F.lit(1)).alias("packets"))


def _ranked(proto: str, n: int) -> str:
    known = TOP_UDP if proto == "udp" else TOP_TCP
    return f"select '{proto}' as proto, {n} as asked, min(rank) as rank, port from {_rows((k, p) for k, p in enumerate(known[: n or None], 1))} t(rank, port) group by port"


_BOTH = sorted({*TOP_TCP, *TOP_UDP})
QUERIES["popular_ports"] = _popular
ORACLES["popular_ports"] = f"""{PACKETS_CTE} select proto, asked, rank, r.port, count(*) as packets from (select port from packets join {_rows(enumerate(_BOTH))} t(i, port) on number % {len(_BOTH)} = i) s
  join ({" union all ".join(_ranked(p, n) for p, n in (("tcp", 0), ("tcp", 100), ("udp", 0), ("udp", 7)))}) r on s.port = r.port group by all"""


QUERIES["undecoded"] = lambda s, d: stats.protocol_breakdown(stats.merge(packets(s, d).where("number % 10 <> 0"), stats.undecoded(frames(s, d).where("number % 10 = 0"))).drop("capture")).select("protocol", "packets")
ORACLES["undecoded"] = f"{PACKETS_CTE} select case when number % 10 = 0 then 'undecoded' else protocol end as protocol, count(*) as packets from packets group by 1"


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over frames of which every tenth breaks off within its network header."""
    cut = frames(spark, sf_dir).withColumn("frame", F.when(F.col("number") % 10 == 0, F.substring("frame", 1, 24)).otherwise(F.col("frame")))
    found = stats.run_summary(to_logical(decode(cut)), field("tcp").exists())
    return found.select("packets", "matched", "filtered_out", "decode_errors")


QUERIES["decode_run_summary"] = _broken
ORACLES["decode_run_summary"] = f"{PACKETS_CTE} select count(*) as packets, count_if(hit)::bigint as matched, count_if(not hit)::bigint as filtered_out, count_if(number % 10 = 0)::bigint as decode_errors from (select *, proto = 'tcp' and number % 10 <> 0 as hit from packets)"

QUERIES["text_hashes"] = lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", fnv1a64(F.encode("url", "UTF-8")).alias("hash"))
ORACLES["text_hashes"] = """select page_id, (case when h >= 9223372036854775808 then h - 18446744073709551616 else h end)::bigint as hash from (select page_id,
  list_reduce(list_transform(range(1, strlen(url) + 1), lambda i: ascii(substr(url, i::bigint, 1))::hugeint), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, 1469598103934665603::hugeint) as h from pages)"""
