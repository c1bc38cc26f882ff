"""Capture files: written and read again, both byte orders, nanoseconds, pcap-ng, breaks, rotation."""

import os
import struct

import pytest

from tidewire.plans.frames import frames
from tidewire.sinks import captures as sink
from tidewire.sources import captures

SF = "/root/testdata/sf0.001"


def pcap(order, rows, magic=0xA1B2C3D4, link=1):
    head = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    return head + b"".join(struct.pack(order + "4I", s, u, len(f), n) + f for s, u, f, n in rows)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("magic,unit", [(0xA1B2C3D4, 1), (0xA1B23C4D, 1000)])
def test_classic(order, magic, unit):
    data = pcap(order, [(7, 5 * unit, b"abc", 3), (8, 0, b"", 0), (9, 1 * unit, b"x", 40)], magic, 113)
    assert list(captures.records(data)) == [(7_000_005, 113, "", b"abc", 3), (8_000_000, 113, "", b"", 0), (9_000_001, 113, "", b"x", 40)]


def block(order, kind, body):
    body += b"\0" * (-len(body) % 4)
    size = struct.pack(order + "I", len(body) + 12)
    return struct.pack(order + "I", kind) + size + body + size


@pytest.mark.parametrize("order", "<>")
def test_blocks(order):
    section = block(order, captures.SECTION, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    named = struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HH4s", 2, 4, b"eth0") + struct.pack(order + "HHB3x", 9, 1, 9) + struct.pack(order + "HH", 0, 0)
    packet = struct.pack(order + "5I", 0, 0, 2_500_000, 3, 60) + b"abc"
    simple = struct.pack(order + "I", 2) + b"hi"
    data = section + block(order, captures.INTERFACE, named) + block(order, 99, b"what") + block(order, captures.ENHANCED, packet) + block(order, captures.STATISTICS, b"\0" * 12) + block(order, captures.SIMPLE, simple)
    assert list(captures.records(data)) == [(2500, 1, "eth0", b"abc", 60), (None, 1, "eth0", b"hi", 2)]


def test_folder_with_breaks(spark, tmp_path):
    whole = pcap("<", [(1, 2, b"abcd", 4), (1, 3, b"ef", 2)])
    (tmp_path / "a.pcap").write_bytes(whole)
    (tmp_path / "b.pcap").write_bytes(whole[:-1])
    (tmp_path / "c.cap").write_bytes(b"no capture at all, but long enough")
    (tmp_path / "d.pcapng").write_bytes(b"")  # Spark passes over files without bytes
    (tmp_path / "other.txt").write_bytes(whole)
    got = captures.read(spark, str(tmp_path))
    rows = sorted((os.path.basename(r.capture), r.number, r.frame and bytes(r.frame), r.error) for r in got.collect())
    assert rows == [("a.pcap", 1, b"abcd", None), ("a.pcap", 2, b"ef", None), ("b.pcap", 1, b"abcd", None), ("b.pcap", 2, None, "short record"), ("c.cap", 1, None, "not a capture")]
    assert captures.good(got).count() == 3


def test_round_trip_and_rotation(spark, tmp_path):
    made = frames(spark, SF).limit(200).cache()
    sink.write(made, str(tmp_path / "one"))
    assert os.listdir(tmp_path / "one") == ["traffic-00000.pcap"]
    columns = ("ts_us", "link_type", "frame", "cap_len", "orig_len")
    rows = lambda df: sorted((r.ts_us, r.link_type, bytes(r.frame), r.cap_len, r.orig_len) for r in df.select(*columns).collect())
    assert rows(captures.good(captures.read(spark, str(tmp_path / "one")))) == rows(made)
    sink.write(made, str(tmp_path / "many"), files=2, rotate=4000, nanoseconds=True)
    names = sorted(os.listdir(tmp_path / "many"))
    assert len(names) > 4 and "traffic-00001-1.pcap" in names and not any(n.startswith(".") for n in names)
    assert rows(captures.good(captures.read(spark, str(tmp_path / "many")))) == rows(made)
    sizes = [os.path.getsize(tmp_path / "many" / n) for n in names]
    assert max(sizes) < 4000 + 16 + 2000
    sink.write(made.limit(3), str(tmp_path / "many"), mode="overwrite")
    assert captures.read(spark, str(tmp_path / "many")).count() == 3
