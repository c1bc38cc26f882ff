"""Replies of UDP services, encoded from the test tables and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.replies import read_replies
from tidewire.plans.bridge import PACKETS_CTE, packets
from tidewire.plans.frames import _be, _counted, _fixed, _name, _text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Kinds of replies, and the port that each comes from.
PORTS = (53, 5353, 123, 161, 161, 1900, 53, 137, 9, 1900, 53, 123)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """number, port and reply: every packet's number picks a kind of reply and fills it in; every thirteenth port is silent."""
    n = F.col("number")
    kind = (n % len(PORTS)).cast("int")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    question = F.concat(_name(F.lit("version.bind")), _fixed("0000100003"))
    header = lambda answers: F.concat(_be(n % 65536, 2), _fixed("85000001" + answers + "00000000"), question)
    record = lambda code, data: F.concat(_fixed("c00c" + code + "000300000000"), _be(F.octet_length(data), 2), data)
    version = F.concat(_counted(F.lit("9.18.")), _counted(n.cast("string")))
    txt = F.concat(header("0001"), record("0010", version))
    address = F.concat(header("0001"), record("0001", _fixed("0a000001")))
    second = F.concat(header("0002"), record("0005", _fixed("c00c")), record("0010", version))
    broken = F.concat(header("0001"), _fixed("c00c0010000300000000" + "00ff"), _counted(F.lit("lost")))
    clock = F.concat(_be(n % 5 * 8 + n % 8, 1), _be(n % 16, 1), _fixed("00" * 46))
    described = F.concat(_fixed("302602010104067075626c6963a219020101"), _fixed("04820000"), _text(said("Linux host", n, " ", F.repeat(F.lit("x"), (n % 140).cast("int")))), _fixed("0500"))
    brief = _fixed("3003020101ff04026162")
    found = _text(said("HTTP/1.1 200 OK\r\nST: upnp:rootdevice\r\nSERVER:  Unix/", n, " UPnP/1.1 \r\nUSN: 1\r\n\r\n"))
    made = (txt, address, clock, described, brief, found, second, _text(said('NetBIOS "', n, '"\n')), _text(said("plain\\", n, "\t\x01")), _text(said("NOTIFY * upnp ", n)), broken, _fixed("1c01"))
    reply = F.when(n % 13 != 0, F.element_at(F.array(*made), kind + 1))
    return packets(spark, sf_dir).select("number", F.element_at(F.array(*map(F.lit, PORTS)), kind + 1).alias("port"), reply.alias("reply"))


def _udp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_replies(replies(spark, sf_dir)).select("number", "port", "state", "service", "product", "version", "extra", "confidence", F.when(~F.col("port").isin(53, 5353, 123, 161), F.col("banner")).alias("banner"))


_PORT_LIST = ", ".join(map(str, PORTS))
_RUN = "'Linux host' || number || ' ' || repeat('x', (number % 140)::int)"
QUERIES["udp_replies"] = _udp
ORACLES["udp_replies"] = f"""{PACKETS_CTE}, asked as (select number, number % {len(PORTS)} as k, ([{_PORT_LIST}])[(number % {len(PORTS)})::int + 1] as port, number % 13 <> 0 as said from packets)
  select number, port, case when said then 'open' else 'open|filtered' end as state,
    case when not said then '' else case when k in (0, 6, 10) then 'dns' when k = 1 then 'mdns' when k = 2 then 'ntp' when k in (3, 4) then 'snmp' when k = 5 then 'upnp' when k = 7 then 'netbios-ssn' else '' end end as service,
    case when not said then '' else case when k in (0, 6) then 'BIND' when k = 2 then 'NTP' when k in (3, 4) then 'SNMP agent' when k = 5 then 'Unix/' || number || ' UPnP/1.1' else '' end end as product,
    case when not said then '' else case when k in (0, 6) then '9.18.' || number when k = 2 then 'v' || (number % 5) else '' end end as version,
    case when not said then '' else case k when 0 then 'version.bind TXT' when 6 then 'version.bind TXT' when 1 then '46 byte DNS response' when 10 then '47 byte DNS response' when 2 then 'mode ' || (number % 8) || ', stratum ' || (number % 16)
      when 3 then 'sysDescr: ' || case when length({_RUN}) > 120 then substr({_RUN}, 1, 117) || '...' else {_RUN} end when 7 then 'probe udp' else '' end end as extra,
    case when not said then 0 else case when k in (0, 6) then 9 when k = 2 then 8 when k in (1, 3, 4, 5, 10) then 7 when k = 7 then 6 else 0 end end::int as confidence,
    case when port in (53, 5353, 123, 161) then null when not said then '' else case k when 5 then 'HTTP/1.1 200 OK\\r\\nST: upnp:rootdevice\\r\\nSERVER:  Unix/' || number || ' UPnP/1.1 \\r\\nUSN: 1\\r\\n\\r\\n'
      when 7 then 'NetBIOS \\"' || number || '\\"\\n' when 8 then 'plain\\\\' || number || '\\t\\x01' else 'NOTIFY * upnp ' || number end end as banner
  from asked"""
