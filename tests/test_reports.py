"""Documents, host tables and text functions that have no SQL, against plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from tidewire.functions import ip as IP
from tidewire.functions import names as N
from tidewire.operators import flows as W
from tidewire.operators import reports, stats, store
from tidewire.filters.fields import logical as field
from tidewire.plans.bridge import packets
from tidewire.sources import hosttables as H

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return packets(spark, SF).cache()


def test_stats_document(rows):
    document = json.loads(reports.stats_json(rows, 5).collect()[0].json)
    totals = stats.totals(rows).collect()[0]
    assert document["packets"] == totals.packets and document["layers"]["tcp"] == totals.tcp and document["tcp_flags"]["syn_ack"] == totals.syn_ack
    wanted = stats.protocol_breakdown(rows).orderBy(F.desc("packets"), "protocol").collect()
    assert [(p["protocol"], p["packets"], p["bytes"]) for p in document["protocols"]] == [(r.protocol, r.packets, r.bytes) for r in wanted]
    assert [t["ip"] for t in document["talkers"]] == [r.ip for r in stats.top_talkers(rows, 5).collect()]
    assert [p["port"] for p in document["tcp_ports"]] == [r.port for r in stats.top_ports(rows, "tcp", 5).collect()]
    assert sum(s["packets"] for s in document["sizes"]) == totals.packets


def test_analysis_document(rows):
    document = json.loads(reports.analysis_json(rows, field("http").exists(), 7, 3).collect()[0].json)
    assert document["summary"]["matched"] == rows.where("kind = 'http'").count()
    assert document["stats"] == json.loads(reports.stats_json(rows, 3).collect()[0].json)
    wanted = W.listed(W.flows(rows), "last", 7).collect()
    assert [(s["a_ip"], s["b_port"], s["last_us"]) for s in document["sessions"]] == [(r.a_ip, r.b_port, r.last_us) for r in wanted]


def test_documents_of_nothing(rows):
    none = rows.where("false")
    document = json.loads(reports.stats_json(none).collect()[0].json)
    assert document["packets"] == 0 and document["protocols"] == [] and sum(s["packets"] for s in document["sizes"]) == 0
    assert reports.packet_json(none).count() == reports.flow_json(reports.detailed_flows(none)).count() == 0


def test_malformed_and_truncated_lines(rows):
    broken = rows.where("proto = 'tcp'").limit(1).withColumns({"malformed": F.lit(True), "malformed_reason": F.lit("short header"), "truncated": F.lit(True)})
    line = reports.packet_lines(broken).collect()[0].line
    assert line[72:80] == "BAD     " and line.endswith("[Malformed packet: short header] [truncated]")
    assert len(reports.packet_lines(broken, 100).collect()[0].line) <= 100


def test_exports(rows):
    assert reports.export("capture", "csv", packets=rows).columns[0] == "number"
    assert reports.export("flows", "json", flows=reports.detailed_flows(rows)).columns[-1] == "json"
    with pytest.raises(ValueError):
        reports.export("scan", "pdf", hosts=rows, ports=rows)
    with pytest.raises(ValueError):
        reports.export("host", "csv")


def test_a_saved_capture_is_replaced(spark, rows, tmp_path):
    found, summary = W.flows(rows), stats.totals(rows)
    for name in ("c1", "c2", "c1"):
        store.save_capture(summary, found, name, str(tmp_path))
    saved = spark.read.parquet(f"{tmp_path}/flows").groupBy("capture_id").count().collect()
    assert {r["capture_id"]: r["count"] for r in saved} == dict.fromkeys(("c1", "c2"), min(found.count(), store.STORED_FLOWS))
    assert spark.read.parquet(f"{tmp_path}/captures").count() == 2


def test_routes(spark, tmp_path):
    path = tmp_path / "route"
    path.write_text(
        "Iface\tDestination\tGateway\tFlags\tRefCnt\tUse\tMetric\tMask\tMTU\n"
        "eth0\t0000A8C0\t00000000\t0001\t0\t0\t100\t00FFFFFF\t0\n"
        "eth1\t00000000\t0101A8C0\t0003\t0\t0\t200\t00000000\t0\n"
        "eth0\t00000000\t0100A8C0\t0003\t0\t0\t50\t00000000\t0\n"
        "eth0\t0500A8C0\t00000000\t0005\t0\t0\t0\tFFFFFFFF\t0\nshort line\n\n"
    )
    found = H.routes(spark, str(path))
    got = [(r.destination, r.prefix, r.gateway, r.metric, r.flags, r.is_default) for r in found.collect()]
    assert got == [
        ("0.0.0.0", 0, "192.168.0.1", 50, "UG", True),
        ("0.0.0.0", 0, "192.168.1.1", 200, "UG", True),
        ("192.168.0.5", 32, "0.0.0.0", 0, "UH", False),
        ("192.168.0.0", 24, "0.0.0.0", 100, "U", False),
    ]
    assert [r.gateway for r in H.default_gateway(found).collect()] == ["192.168.0.1"]
    assert [r.gateway for r in H.default_gateway(found, "eth1").collect()] == ["192.168.1.1"]
    assert H.default_gateway(found, "none").count() == 0


def test_routes6_and_neighbours(spark, tmp_path):
    six = tmp_path / "route6"
    six.write_text(f"{'20010db8' + '0' * 24} 40 {'0' * 32} 00 {'0' * 32} 00000100 0 0 1 eth0\n{'0' * 32} 00 {'0' * 32} 00 {'fe80' + '0' * 27 + '1'} 00000400 0 0 3 eth0\n")
    assert [(r.destination[:10], r.prefix, r.metric, r.is_default) for r in H.routes6(spark, str(six)).collect()] == [("0600000000", 0, 1024, True), ("0620010db8", 64, 256, False)]
    arp = tmp_path / "arp"
    arp.write_text("IP address HW type Flags HW address Mask Device\n192.168.0.1 0x1 0x2 00:50:56:AA:00:01 * eth0\n192.168.0.9 0x1 0x0 00:00:00:00:00:00 * eth0\n192.168.0.7 0x1 0x4 02:00:00:00:00:07 * eth1\n")
    assert sorted(tuple(r) for r in H.neighbours(spark, str(arp)).collect()) == [
        ("192.168.0.1", "00:50:56:aa:00:01", "eth0", "complete"),
        ("192.168.0.7", "02:00:00:00:00:07", "eth1", "permanent"),
        ("192.168.0.9", None, "eth0", "incomplete"),
    ]
    nd = tmp_path / "nd"
    nd.write_text("fe80::1 dev eth0 lladdr 02:00:00:00:00:01 REACHABLE\nfe80::2 dev eth1 router FAILED\nfe80::3 FAILED\n")
    assert [tuple(r) for r in H.neighbours6(spark, str(nd)).collect()] == [("fe80::1", "02:00:00:00:00:01", "eth0", "REACHABLE"), ("fe80::2", None, "eth1", "FAILED")]


def test_hex_dump(spark):
    data = [(bytes(range(60, 80)),), (b"",), (None,), (b"x" * 300,)]
    got = [r[0] for r in spark.createDataFrame(data, "b binary").select(N.hex_dump(F.col("b"))).collect()]
    assert got[0] == [
        "00000000   3c 3d 3e 3f 40 41 42 43  44 45 46 47 48 49 4a 4b  |<=>?@ABCDEFGHIJK|",
        "00000010   4c 4d 4e 4f" + " " * (12 * 3 + 1 + 2) + "|LMNO|",
    ]
    assert got[1] == [] and got[2] is None and len(got[3]) == 17 and got[3][-1] == "... (44 more bytes)"


def test_templates_and_binary(spark):
    df = spark.createDataFrame([("$1 v$2 ($1) $9", ["a", None]), ("plain ", [])], "t string, g array<string>")
    assert [r[0] for r in df.select(N.expand_template(F.col("t"), F.col("g"))).collect()] == ["a v ($1)", "plain"]
    texts = spark.createDataFrame([(b"GET / HTTP/1.1\r\n",), (bytes(7) + b"abc",), (b"",), (None,), (b"a" * 69 + bytes(31),)], "b binary")
    assert [r[0] for r in texts.select(N.looks_binary(F.col("b"))).collect()] == [False, True, False, False, True]


def test_address_classes(spark):
    wanted = {
        "0.0.0.0": "unspecified", "127.9.9.9": "loopback", "::1": "loopback", "255.255.255.255": "broadcast", "239.1.1.1": "multicast", "ff02::1": "multicast", "169.254.3.4": "link-local", "fe80::1": "link-local",
        "172.31.0.1": "private", "172.32.0.1": "public", "fd00::1": "private", "100.64.0.1": "reserved", "100.128.0.1": "public", "198.19.1.1": "reserved", "198.20.0.1": "public", "192.0.2.1": "reserved", "241.0.0.1": "reserved", "8.8.8.8": "public",
    }
    df = spark.createDataFrame([(a, IP.key_of(a)) for a in wanted], "address string, key string")
    assert {r[0]: r[1] for r in df.select("address", IP.ip_class(F.col("key"))).collect()} == wanted
