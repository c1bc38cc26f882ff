"""Services from a file, replies and hashes of odd rows, against plain Python."""

from pyspark.sql import functions as F

from tidewire.functions.lookups import services_from, service_name, top_ports
from tidewire.functions.text import FNV_PRIME, FNV_START, escaped, fnv1a64
from tidewire.operators.replies import longest_printable, read_replies


def test_services_of_a_system(spark, tmp_path):
    (tmp_path / "services").write_text("# names\nssh2 22/tcp\nlocal\t7777/tcp alias # mine\nother 7777/TCP\nlocal 7777/udp\nbroken\nbad x/tcp\n\n")
    more = services_from(spark, str(tmp_path / "services"))
    assert sorted(map(tuple, more.collect())) == [(22, "tcp", "ssh2"), (7777, "tcp", "local"), (7777, "udp", "local")]
    asked = spark.createDataFrame([(22, "tcp"), (7777, "tcp"), (7777, "udp"), (7778, "tcp")], "port int, proto string")
    assert {(r.port, r.proto): r.service for r in service_name(asked, more=more).collect()} == {(22, "tcp"): "ssh", (7777, "tcp"): "local", (7777, "udp"): "local", (7778, "tcp"): "unknown"}


def test_top_ports(spark):
    assert [tuple(r) for r in top_ports(spark, "udp", 3).collect()] == [(1, 631), (2, 161), (3, 1434)]
    assert top_ports(spark, "tcp").select("port").distinct().count() == top_ports(spark, "tcp").count() == 179


def test_odd_replies(spark):
    rows = [(53, None), (53, b""), (53, b"\0" * 11), (53, b"\xff" * 40), (123, b"\x1c"), (161, b"ab"), (161, b"\x00\xff\x80"), (1900, b"HTTP/1.1 200 OK"), (7, b""), (7, b"x" * 300)]
    got = read_replies(spark.createDataFrame(rows, "port int, reply binary")).orderBy(F.monotonically_increasing_id()).collect()
    assert [r.state for r in got] == ["open|filtered"] + ["open"] * 9
    assert [r.service for r in got] == ["", "dns", "dns", "dns", "", "", "snmp", "upnp", "", ""]
    assert [r.extra for r in got[:4]] == ["", "0 byte DNS response", "11 byte DNS response", "40 byte DNS response"]
    assert got[7].product == "" and got[9].banner == "x" * 217 + "..."
    assert read_replies(spark.createDataFrame([], "port int, reply binary")).count() == 0


def test_texts(spark):
    texts = ["", "a\"b\\c\n\r\t\x01\x7f", "\x00ab\x01cde\x02fgh", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(escaped(F.col("t")).alias("e"), longest_printable(F.col("t")).alias("r")).collect()
    assert [r.e for r in df] == ["", 'a\\"b\\\\c\\n\\r\\t\\x01\\x7f', "\\x00ab\\x01cde\\x02fgh", "é"]
    assert [r.r for r in df] == ["", 'a"b\\c', "cde", ""]


def test_hashes(spark):
    values = [b"", b"a", None, b"hello world", bytes(range(256)) * 9]

    def plain(data):
        h = FNV_START
        for b in data:
            h = (h ^ b) * FNV_PRIME % 2**64
        return h - 2**64 if h >= 2**63 else h

    got = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v binary").select("k", fnv1a64("v").alias("h")).collect()
    assert {r.k: r.h for r in got} == {k: None if v is None else plain(v) for k, v in enumerate(values)}
