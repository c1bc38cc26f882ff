"""Frames made byte by byte: options, fragments, link types, broken headers, DNS, TLS and DHCP bodies."""

import ipaddress
import random
import struct

import pyarrow as pa
import pytest

from tidewire.decode import dns, tls
from tidewire.decode.batch import Bytes
from tidewire.decode.frames import decode, to_logical
from tidewire.decode.layout import REASONS

MACS = bytes.fromhex("aabbccddeeff112233445566")


def words(data):
    data += b"\0" * (len(data) % 2)
    total = sum(struct.unpack(f">{len(data) // 2}H", data))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return total


def ip4(body, proto, options=b"", frag=0x4000, src="10.0.0.1", dst="10.0.0.2"):
    size = 20 + len(options)
    head = lambda check: struct.pack(">BBHHHBBH4s4s", 0x40 | size // 4, 0, size + len(body), 7, frag, 64, proto, check, ipaddress.ip_address(src).packed, ipaddress.ip_address(dst).packed) + options
    return head(0xFFFF - words(head(0))) + body


def tcp(body=b"", options=b"", sport=4000, dport=9999, flags=0x18, offset=None):
    n = 5 + len(options) // 4 if offset is None else offset
    return struct.pack(">HHIIBBHHH", sport, dport, 100, 777, n << 4, flags, 512, 0, 0) + options + body


def udp(body, sport=4000, dport=9999):
    return struct.pack(">HHHH", sport, dport, 8 + len(body), 0) + body


def ether(body, kind=0x0800, tags=b""):
    return MACS + tags + struct.pack(">H", kind) + body


def decoded(spark, frames):
    rows = [(k, 1_000_000 * k, link, "", f, len(f), len(f)) for k, (link, f) in enumerate(frames)]
    df = spark.createDataFrame(rows, "number long, ts_us long, link_type int, interface string, frame binary, cap_len int, orig_len int").coalesce(1)
    return {r.number: r for r in decode(df).collect()}


def test_tcp_options_in_any_order(spark):
    made = {
        "mss": (b"\x02\x04\x05\xb4", ("MSS", "1460")),
        "scale": (b"\x03\x03\x07", ("Window scale", "7")),
        "permitted": (b"\x04\x02", ("SACK permitted", "")),
        "sack": (b"\x05\x0a" + bytes(range(8)), ("SACK", "00:01:02:03:04:05:06:07")),
        "stamps": (b"\x08\x0a" + struct.pack(">II", 5, 4_000_000_000), ("Timestamps", "TSval 5 TSecr 4000000000")),
        "md5": (b"\x13\x04zz", ("TCP MD5 signature", "")),
        "ao": (b"\x1d\x03z", ("TCP-AO", "")),
        "tfo": (b"\x22\x02", ("TFO (fast open)", "")),
        "other": (b"\xfd\x04\xab\xcd", ("kind 253", "abcd")),
        "nop": (b"\x01", ("NOP", "")),
    }
    rng = random.Random(4)
    frames, wants = [], []
    for _ in range(60):
        chosen = rng.sample(list(made.values()), rng.randint(0, 5))
        raw, want = b"".join(c[0] for c in chosen), [c[1] for c in chosen]
        if len(raw) > 40:
            continue
        pad = -len(raw) % 4
        frames.append((1, ether(ip4(tcp(b"hello", raw + b"\0" * pad), 6))))
        wants.append(want + [("End of options", "")] * bool(pad))
    # a length that reaches past the header ends the list
    frames.append((1, ether(ip4(tcp(b"", b"\x01\x02\x09\x05"), 6))))
    wants.append([("NOP", "")])
    got = decoded(spark, frames)
    for k, want in enumerate(wants):
        tcp_row = got[k].tcp
        assert [(o.name, o.value) for o in tcp_row.options] == want
        assert tcp_row.mss == (1460 if ("MSS", "1460") in want else None)
        assert got[k].info.endswith(f"Len={len(got[k].payload)}" + (" MSS=1460" if tcp_row.mss else ""))
    assert bytes(got[0].payload) == b"hello"


def test_ip_options_fragments_and_links(spark):
    inner = ip4(udp(b"abc"), 17)
    v6 = lambda nxt, body: struct.pack(">IHBB", 0x60000000, len(body), nxt, 64) + bytes(15) + b"\1" + bytes(15) + b"\2" + body
    hop = struct.pack(">BB6x", 17, 0)
    frames = [
        (1, ether(ip4(udp(b"abc"), 17, b"\x07\x04\x00\x00\x01\x83\x03\x00"))),
        (1, ether(ip4(b"xyz", 17, frag=0x2000))),
        (1, ether(ip4(b"xyz", 17, frag=0x0005))),
        (1, ether(ip4(b"xyz", 89))),
        (113, struct.pack(">HHH8sH", 0, 1, 6, bytes(8), 0x0800) + inner),
        (276, struct.pack(">HHIHBB8s", 0x0800, 0, 3, 1, 4, 6, bytes(8)) + inner),
        (9, b"\x00\x21" + inner),
        (101, inner),
        (228, inner),
        (229, v6(17, udp(b"abc"))),
        (0, struct.pack("<I", 2) + inner),
        (108, struct.pack(">I", 30) + v6(17, udp(b"abc"))),
        (101, v6(0, hop + udp(b"abc"))),
        (101, v6(44, struct.pack(">BBHI", 17, 0, 0x0010, 1) + b"abcdefgh")),
        (1, MACS + bytes.fromhex("88a80064") + bytes.fromhex("810020c8") + struct.pack(">H", 0x0800) + inner),
        (147, inner),
        (1, ether(b"zz", 0x88CC)),
        (1, ether(b"zz", 0x9000)),
    ]
    got = decoded(spark, frames)
    assert [(o.name, o.value) for o in got[0].ipv4.options] == [("Record route", "0000"), ("NOP", ""), ("option 131", "00")]
    assert [got[k].info for k in (1, 2, 3)] == ["10.0.0.1 → 10.0.0.2 UDPfragment offset=0 more=yes", "10.0.0.1 → 10.0.0.2 UDPfragment offset=40 more=no", "10.0.0.1 → 10.0.0.2 OSPF"]
    assert [got[k].protocol for k in (1, 2, 3)] == ["IPv4 fragment", "IPv4 fragment", "IPv4"]
    for k in (0, *range(4, 13), 14):
        assert got[k].udp.dst_port == 9999 and bytes(got[k].payload) == b"abc" and got[k].udp.checksum_valid == (got[k].ipv4 is not None), k
        assert got[k].info == "4000 → 9999 Len=3 [616263]"
    assert got[13].udp is None and got[13].fragment and got[13].protocol == "IPv6" and bytes(got[13].payload) == b"abcdefgh"
    assert [(v.id, v.priority) for v in got[14].vlans] == [(100, 0), (200, 1)] and got[14].layers == ["eth", "vlan", "vlan", "ip", "udp", "data"]
    assert [got[k].protocol for k in (15, 16, 17)] == ["linktype UNKNOWN", "LLDP", "EtherType 0x9000"]
    assert got[4].layers[0] == "sll" and got[5].sll.ether_type == 0x0800


def test_where_frames_break_off(spark):
    ok = ip4(tcp(), 6)
    v6 = struct.pack(">IHBB", 0x60000000, 0, 6, 64) + bytes(32)
    frames = [
        (1, b"short"), (1, MACS + b"\x81\x00\x00"), (113, bytes(15)), (0, b"\2\0"), (1, ether(ok[:19])), (1, ether(b"\x65" + ok[1:])), (1, ether(b"\x44" + ok[1:])), (1, ether(v6[:39], 0x86DD)),
        (1, ether(bytes(27), 0x0806)), (1, ether(ip4(tcp()[:19], 6))), (1, ether(ip4(tcp(offset=3), 6))), (1, ether(ip4(udp(b"")[:7], 17))), (1, ether(ip4(b"\x08\0\0\0", 1))),
    ]
    got = decoded(spark, frames)
    assert [got[k].reason for k in range(len(frames))] == list(REASONS)
    assert all(r.malformed and r.info == f"[Malformed packet: {r.reason}]" for r in got.values())
    assert got[10].tcp.src_port == 4000 and got[10].tcp.options == []
    # bytes at random never stop the decoder
    rng = random.Random(2)
    noise = decoded(spark, [(rng.choice((0, 1, 9, 12, 101, 113, 228, 229, 276, 999)), rng.randbytes(rng.randint(0, 90))) for _ in range(400)] + [(1, ether(ip4(tcp(rng.randbytes(60), sport=rng.choice((53, 443, 80))), 6))) for _ in range(200)])
    assert len(noise) == 600


def test_arp_icmp_dhcp(spark):
    arp = lambda op: ether(struct.pack(">HHBBH6s4s6s4s", 1, 0x0800, 6, 4, op, MACS[6:], bytes([10, 0, 0, 1]), bytes(6), bytes([10, 0, 0, 2])), 0x0806)
    boot = struct.pack(">BBBBI8x4s4s8x6s10x64x128x", 2, 1, 6, 0, 0xABCD, bytes([10, 0, 0, 9]), bytes(4), MACS[:6])
    boot = boot[:12] + bytes(4) + bytes([10, 0, 0, 9]) + bytes(8) + MACS[:6] + bytes(10 + 64 + 128) + b"\x63\x82\x53\x63"
    options = b"\x35\x01\x05\x00\x36\x04\x0a\x00\x00\x01\x33\x04\x00\x00\x0e\x10\x0c\x02hi\x3c\x03abc\x32\x04\x0a\x00\x00\x07\xff"
    frames = [(1, arp(k)) for k in (1, 2, 8, 3, 77)] + [(1, ether(ip4(b"\x03\x01\0\0\0\0\0\0data", 1))), (1, ether(ip4(udp(boot + options, 67, 68), 17)))]
    got = decoded(spark, frames)
    assert [got[k].info for k in range(6)] == ["Who has 10.0.0.2? Tell 10.0.0.1", "10.0.0.1 is at 11:22:33:44:55:66", "Gratuitous ARP for 10.0.0.1 (11:22:33:44:55:66)", "ARP request reverse", "ARP opcode 77", "Destination host unreachable len=4"]
    d = got[6].dhcp
    assert (d.message_type, d.server_id, d.lease_seconds, d.hostname, d.vendor_class, d.requested_ip, d.your_ip) == (5, "10.0.0.1", 3600, "hi", "abc", "10.0.0.7", "10.0.0.9")
    assert got[6].info == "BOOTP reply - ACK xid=0x0000abcd yiaddr=10.0.0.9 client=aa:bb:cc:dd:ee:ff (Message-Type: ACK; Server-ID: 10.0.0.1; Lease-Time: 3600s; Hostname: hi; Vendor-Class: abc; Requested-IP: 10.0.0.7)"
    flat = to_logical(decode(spark.createDataFrame([(0, 0, 1, "", frames[5][1], 1, 1)], "number long, ts_us long, link_type int, interface string, frame binary, cap_len int, orig_len int"))).first()
    assert flat.info == "Destination host unreachable len=4" and flat.icmp_code == 1 and flat.dns_rcode is None


def name(text):
    return b"".join(bytes([len(x)]) + x.encode("latin-1") for x in text.split(".") if x) + b"\0"


def message(flags, questions, records, counts=None):
    counts = counts or (len(questions), len(records), 0, 0)
    out = struct.pack(">6H", 5, flags, *counts) + b"".join(name(q) + struct.pack(">HH", t, 1) for q, t in questions)
    for owner, kind, data in records:
        out += (owner if isinstance(owner, bytes) else name(owner)) + struct.pack(">HHIH", kind, 1, 60, len(data)) + data
    return out


def walked(*payloads):
    return dns._Messages(Bytes(pa.array(payloads, pa.binary()))).struct().to_pylist()


def test_dns_records_and_pointers():
    back = b"\xc0\x0c"
    records = [
        (back, 1, bytes([1, 2, 3, 4])), (back, 28, bytes(15) + b"\1"), (back, 2, b"\2ns" + back), (back, 6, b"\2ns" + back + b"\5admin" + back + struct.pack(">5I", 1, 2, 3, 4, 4_000_000_000)),
        (back, 15, b"\0\x0a" + back), (back, 16, b"\2hi\3you"), (back, 33, struct.pack(">3H", 1, 2, 443) + back), ("", 41, b"abcd"), (back, 257, b"\0\5issueca.example"), (back, 99, b"\xab\xcd"), (back, 1, b"\1\2"),
    ]
    (m,) = walked(message(0x8183, [("wwé.example.com", 255)], records))
    assert m["valid"] and not m["is_query"] and m["rcode"] == 3 and m["questions"] == [{"name": "wwé.example.com", "type": 255, "type_name": "ANY"}]
    host = "wwé.example.com"
    assert [a["data"] for a in m["answers"]] == ["1.2.3.4", "::1", f"ns.{host}", f"ns.{host} admin.{host} 1 2 3 4 4000000000", f"10 {host}", "hi you", f"1 2 443 {host}", "EDNS0 (4 bytes)", 'issue "ca.example"', "abcd", "0102"]
    assert [a["name"] for a in m["answers"]] == [host] * 7 + ["<root>"] + [host] * 3 and m["answers"][0]["key"] == "0401020304"


def test_dns_that_breaks_off():
    good = message(0x0100, [("a.b", 1)], [])
    loop = struct.pack(">6H", 1, 0x0100, 1, 0, 0, 0) + b"\xc0\x0c\0\1\0\1"
    section = message(0x8180, [("a.b", 1)], [("a.b", 1, b"\1\2\3\4")] * 3, (1, 1, 1, 1))
    cut = message(0x8180, [("a.b", 1)], [("a.b", 1, b"\1\2\3\4")])
    many = struct.pack(">6H", 1, 0, 65, 0, 0, 0)
    got = walked(good, None, b"short", loop, section, cut[:-2], cut[:-4], many, good + b"tail")
    assert [g is None for g in got] == [False, True, True, True, False, False, False, True, False]
    assert [len(got[4][s]) for s in dns.SECTIONS] == [1, 1, 1]
    assert not got[5]["valid"] and got[5]["answers"][0]["data"] == "0102" and not got[6]["valid"] and got[6]["answers"][0]["data"] == ""
    assert got[8]["valid"]
    rng = random.Random(9)
    for _ in range(30):
        walked(*[good[:4] + rng.randbytes(rng.randint(0, 60)) for _ in range(20)])


def hello(kind, suites, extensions, session=b"abc"):
    listed = b"".join(struct.pack(">H", s) for s in suites)
    chosen = struct.pack(">H", len(listed)) + listed + b"\1\0" if kind == 1 else listed + b"\0"
    more = b"".join(struct.pack(">HH", k, len(v)) + v for k, v in extensions)
    body = b"\3\3" + bytes(32) + bytes([len(session)]) + session + chosen + struct.pack(">H", len(more)) + more
    return bytes([kind]) + len(body).to_bytes(3, "big") + body


def record(kind, body, version=0x0303):
    return struct.pack(">BHH", kind, version, len(body)) + body


def test_tls_hellos():
    sni = lambda n: struct.pack(">HBH", len(n) + 3, 0, len(n)) + n
    client = record(22, hello(1, [0x1301, 0xC02F], [(10, b"zz"), (0, sni(b"host.example"))]), 0x0301)
    server = record(22, hello(2, [0x1302], [(43, b"\3\4")]))
    alert = record(21, b"\2\x28")
    (c, s, a, x, none) = tls.segments.func(pa.array([client, server + record(20, b"\1"), alert, record(23, b"data"), b"no tls at all"], pa.binary())).to_pylist()
    assert (c["sni"], c["suites"], c["handshake_type"], c["version"]) == ("host.example", [0x1301, 0xC02F], 1, 0x0301)
    assert (s["version"], s["suites"], s["handshake_type"], len(s["records"])) == (0x0304, [0x1302], 2, 2)
    assert (a["alert_level"], a["alert"], a["handshake_type"]) == (2, 40, 0) and x["records"] == [{"content_type": 23, "version": 0x0303, "length": 4}] and none is None


@pytest.mark.parametrize("size", (7, 40, 90, 5000))
def test_tls_server_stream_over_records(size):
    certificates = [b"first certificate" * 3, b"second"]
    listed = b"".join(len(c).to_bytes(3, "big") + c for c in certificates)
    body = len(listed).to_bytes(3, "big") + listed
    stream = hello(2, [0xC02F], [(43, b"\3\4")]) + b"\x0b" + len(body).to_bytes(3, "big") + body
    data = b"".join(record(22, stream[k : k + size]) for k in range(0, len(stream), size)) + record(21, b"\1\0")
    got = tls.server_streams.func(pa.array([data, record(21, b"\2\x46"), b"HTTP/1.1 200 OK", record(22, hello(2, [0x2F], [])), None], pa.binary())).to_pylist()
    assert got[0] == {"record_version": 0x0303, "version": 0x0304, "suite": 0xC02F, "alert_level": 1, "alert": 0, "certificate_count": 2, "certificates": certificates}
    assert (got[1]["alert_level"], got[1]["alert"], got[1]["version"], got[1]["certificate_count"]) == (2, 70, None, 0)
    assert got[2] is None and got[4] is None and (got[3]["version"], got[3]["suite"]) == (0x0303, 0x2F)
