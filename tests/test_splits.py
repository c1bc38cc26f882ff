"""Captures read by ranges give the rows of the whole reader, whatever frames hold and wherever they are cut."""

import random
import struct

import pytest

from tidewire.sources import captures, splits


def pcap(order, rows, magic=0xA1B2C3D4):
    return struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack(order + "4I", s, u, len(f), n) + f for s, u, f, n in rows)


def sortable(df):
    return sorted((r.capture, r.number, r.ts_us or 0, r.link_type or 0, bytes(r.frame or b""), r.orig_len or 0, r.error or "") for r in df.collect())


@pytest.mark.parametrize("size", (37, 200, 1000, 1 << 20))
def test_same_rows_as_whole_files(spark, tmp_path, size):
    rng = random.Random(size)
    frame = lambda: rng.randbytes(rng.randint(0, 90))
    rows = [(k, k * 7 % 1_000_000, f := frame(), len(f)) for k in range(40)]
    # frames that hold captures of their own, so that ranges begin at the wrong records
    inner = pcap("<", [(1, 2, b"x" * 20, 20)] * 12)[24:]
    odd = [(k, 5, inner if k % 4 == 1 else frame(), 600) for k in range(12)]
    (tmp_path / "a.pcap").write_bytes(pcap("<", rows))
    (tmp_path / "b.pcap").write_bytes(pcap(">", odd, 0xA1B23C4D))
    (tmp_path / "c.pcap").write_bytes(pcap("<", odd))
    (tmp_path / "d.pcap").write_bytes(pcap("<", rows)[:-3])
    (tmp_path / "e.cap").write_bytes(b"no capture at all, but long enough")
    (tmp_path / "f.pcap").write_bytes(pcap("<", []))
    got = splits.read(spark, str(tmp_path), size)
    assert sortable(got) == sortable(captures.read(spark, str(tmp_path)))
    if size == 200:
        assert splits.ranges(spark, str(tmp_path), size).count() > 30
