"""Where the headers of a frame lie and the numbers in them: one pass over an Arrow batch of frames.

Every step below handles all frames of a batch at once, so no Python object is made for a
frame.  What comes out are numbers and offsets; texts (addresses, names) are built from them
by Spark's own functions, and only where a query asks for them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.decode.batch import Bytes, folded, integers, listed, numbers, options, read_once

ETHERNET, PPP, RAW, SLL, IPV4_ONLY, IPV6_ONLY, SLL2 = 1, 9, (12, 101), 113, 228, 229, 276
LOOPBACK = (0, 108)
KNOWN = (ETHERNET, PPP, *RAW, SLL, IPV4_ONLY, IPV6_ONLY, SLL2, *LOOPBACK)
VLAN_TYPES = (0x8100, 0x88A8)
IPV4, IPV6, ARP = 0x0800, 0x86DD, 0x0806
#: IPv6 extension headers that carry their length; a fragment header has none.
EXTENSIONS, FRAGMENT = (0, 43, 51, 60, 135), 44
TCP, UDP, ICMP, ICMP6 = 6, 17, 1, 58

#: What is said of a frame that breaks off, in the order of the layers.
REASONS = (
    "frame shorter than an Ethernet header", "truncated VLAN tag", "frame shorter than a Linux cooked header", "truncated loopback header", "truncated IPv4 header", "IPv4 version field is not 4",
    "invalid IPv4 header length", "truncated IPv6 header", "truncated ARP packet", "truncated TCP header", "invalid TCP data offset", "truncated UDP header", "truncated ICMP header",
)

_INTS = (
    "tags", "ether_type", "net", "ip", "ihl", "tos", "total_length", "identification", "fragment_bits", "ttl", "ip_protocol", "ip_checksum", "flow_word", "proto", "l4", "end", "layer",
    "src_port", "dst_port", "tcp_header", "tcp_flags", "window", "checksum", "udp_length", "icmp_type", "icmp_code", "icmp_id", "icmp_sequence", "body", "body_size", "reason",
)
_LONGS = ("seq", "ack")
_BOOLS = ("arp", "fragment", "ip_checksum_valid", "checksum_valid")
OPTION = T.StructType([T.StructField(n, T.IntegerType(), False) for n in ("kind", "at", "size")])
LAYOUT = T.StructType(
    [
        *[T.StructField(n, T.IntegerType()) for n in _INTS],
        *[T.StructField(n, T.LongType()) for n in _LONGS],
        *[T.StructField(n, T.BooleanType()) for n in _BOOLS],
        T.StructField("ip_options", T.ArrayType(OPTION, False)),
        T.StructField("tcp_options", T.ArrayType(OPTION, False)),
    ]
)


class _Layout:
    """Columns of numbers, each with the rows where it has a value."""

    def __init__(self, frames: Bytes, link: np.ndarray) -> None:
        self.f, self.n = frames, len(frames)
        self.columns: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.reason = np.full(self.n, -1, dtype=np.int64)
        self._link(link)
        self._network()
        self._extensions()
        self._transport()
        self._checksums()

    def put(self, name: str, values: np.ndarray, where: np.ndarray) -> None:
        self.columns[name] = (values, where)

    def _breaks(self, where: np.ndarray, reason: str) -> None:
        self.reason = np.where(where & (self.reason < 0), REASONS.index(reason), self.reason)

    def _link(self, link: np.ndarray) -> None:
        f, size = self.f, self.f.size
        kind, net = np.zeros(self.n, dtype=np.int64), np.zeros(self.n, dtype=np.int64)
        ethernet = link == ETHERNET
        short = ethernet & (size < 14)
        self._breaks(short, "frame shorter than an Ethernet header")
        stopped = short | ~np.isin(link, KNOWN) | ~f.given
        kind[ethernet], net[ethernet] = f.uint(12, 2)[ethernet], 14
        tags = np.zeros(self.n, dtype=np.int64)
        for _ in range(4):
            tagged = ethernet & ~stopped & np.isin(kind, VLAN_TYPES)
            cut = tagged & (size < net + 4)
            self._breaks(cut, "truncated VLAN tag")
            stopped |= cut
            tagged &= ~cut
            kind = np.where(tagged, f.uint(net + 2, 2), kind)
            net, tags = net + 4 * tagged, tags + tagged
        cooked = link == SLL
        self._breaks(cooked & (size < 16), "frame shorter than a Linux cooked header")
        kind, net = np.where(cooked & (size >= 16), f.uint(14, 2), kind), np.where(cooked & (size >= 16), 16, net)
        cooked2 = (link == SLL2) & (size >= 20)
        kind, net = np.where(cooked2, f.uint(0, 2), kind), np.where(cooked2, 20, net)
        by_version = np.where(f.uint(0) >> 4 == 6, IPV6, IPV4)
        kind = np.where(np.isin(link, RAW), by_version, kind)
        kind = np.where(link == IPV4_ONLY, IPV4, np.where(link == IPV6_ONLY, IPV6, kind))
        loop = np.isin(link, LOOPBACK)
        self._breaks(loop & (size < 4), "truncated loopback header")
        stopped |= loop & (size < 4)
        family = f.uint(0, 4)
        inner = np.where(f.uint(4) >> 4 == 6, IPV6, IPV4)
        kind = np.where(loop, np.where(np.isin(family, (2, 0x02000000)), IPV4, np.where(np.isin(family, (24, 28, 30)), IPV6, inner)), kind)
        net = np.where(loop, 4, net)
        ppp = link == PPP
        kind, net = np.where(ppp, np.where((size >= 2) & (f.uint(0) == 0), IPV4, IPV6), kind), np.where(ppp, 2, net)
        self.kind, self.net, self.stopped = kind, net, stopped
        self.put("tags", tags, f.given)
        self.put("ether_type", kind, ~stopped)
        self.put("net", net, ~stopped)

    def _network(self) -> None:
        f, net, size = self.f, self.net, self.f.size
        wants4, wants6, wants_arp = (~self.stopped & (self.kind == k) for k in (IPV4, IPV6, ARP))
        first = f.uint(net)
        ihl = (first & 15) * 4
        self._breaks(wants4 & (size < net + 20), "truncated IPv4 header")
        self._breaks(wants4 & (first >> 4 != 4), "IPv4 version field is not 4")
        self._breaks(wants4 & ((ihl < 20) | (size < net + ihl)), "invalid IPv4 header length")
        self._breaks(wants6 & (size < net + 40), "truncated IPv6 header")
        self._breaks(wants_arp & (size < net + 28), "truncated ARP packet")
        fine = self.reason < 0
        self.v4, self.v6, self.arp = wants4 & fine, wants6 & fine, wants_arp & fine
        self.ihl = ihl
        either = self.v4 | self.v6
        self.put("ip", np.where(self.v4, 4, 6), either)
        self.put("arp", self.arp, f.given)
        self.put("ihl", ihl, self.v4)
        self.put("tos", f.uint(net + 1), self.v4)
        self.total = np.where(self.v4, f.uint(net + 2, 2), f.uint(net + 4, 2))
        self.put("total_length", self.total, either)
        self.put("identification", f.uint(net + 4, 2), self.v4)
        bits = f.uint(net + 6, 2)
        self.put("fragment_bits", bits, self.v4)
        self.put("ttl", np.where(self.v4, f.uint(net + 8), f.uint(net + 7)), either)
        self.protocol = np.where(self.v4, f.uint(net + 9), f.uint(net + 6))
        self.put("ip_protocol", self.protocol, either)
        self.put("ip_checksum", f.uint(net + 10, 2), self.v4)
        self.put("flow_word", f.uint(net, 4) & 0x0FFFFFFF, self.v6)
        self.fragment = self.v4 & (bits & 0x3FFF != 0)
        self.ip_options = options(f, net + 20, net + ihl, np.flatnonzero(self.v4 & (ihl > 20)), 2, (1,), 0)

    def _extensions(self) -> None:
        """Protocol and offset of the transport header; extension headers are stepped over, eight at most."""
        f = self.f
        at, proto = self.net + np.where(self.v4, self.ihl, 40), self.protocol.copy()
        going = self.v6.copy()
        lost = self.fragment.copy()
        for _ in range(8):
            plain, cut = going & np.isin(proto, EXTENSIONS), going & (proto == FRAGMENT)
            lost |= (plain & (f.size < at + 2)) | (cut & (f.size < at + 8))
            later = cut & ~lost & (f.uint(at + 2, 2) & 0xFFF9 != 0)
            self.fragment |= later
            lost |= later
            going = (plain | cut) & ~lost
            if not going.any():
                break
            step = np.where(proto == FRAGMENT, 8, (f.uint(at + 1) + 1) * 8)
            proto, at = np.where(going, f.uint(at), proto), np.where(going, at + step, at)
            going = going.copy()
        either = self.v4 | self.v6
        self.l4, self.proto, self.whole = at, proto, either & ~lost
        # a fragment's payload begins behind its header
        self.rest = np.where(self.v6 & self.fragment, at + 8, at)
        left = np.maximum(f.size - at, 0)
        inner = np.where(self.v4, self.total - self.ihl, self.total + 40 - (at - self.net))
        self.segment = np.where((inner > 0) & (inner <= left), inner, left)
        self.put("fragment", self.fragment, f.given)
        self.put("proto", proto, self.whole)
        self.put("l4", at, self.whole)
        self.put("end", at + self.segment, self.whole)

    def _transport(self) -> None:
        f, at, size, whole = self.f, self.l4, self.f.size, self.whole
        wants = {p: whole & (self.proto == p) for p in (TCP, UDP, ICMP, ICMP6)}
        self._breaks(wants[TCP] & (size < at + 20), "truncated TCP header")
        tcp = wants[TCP] & (size >= at + 20)
        header = (f.uint(at + 12) >> 4) * 4
        odd = tcp & ((header < 20) | (size < at + header))
        self._breaks(odd, "invalid TCP data offset")
        self._breaks(wants[UDP] & (size < at + 8), "truncated UDP header")
        udp = wants[UDP] & (size >= at + 8)
        pinged = wants[ICMP] | wants[ICMP6]
        self._breaks(pinged & (size < at + 8), "truncated ICMP header")
        icmp = pinged & (size >= at + 8)
        layer = np.select([tcp, udp, icmp], [TCP, UDP, ICMP], 0)
        self.layer, self.tcp_whole = layer, tcp & ~odd
        self.put("layer", layer, layer > 0)
        ported = tcp | udp
        self.put("src_port", np.where(ported, f.uint(at, 2), 0), f.given)
        self.put("dst_port", np.where(ported, f.uint(at + 2, 2), 0), f.given)
        for name, where, values in (
            ("seq", tcp, f.uint(at + 4, 4)),
            ("ack", tcp, f.uint(at + 8, 4)),
            ("tcp_header", tcp, header),
            ("tcp_flags", tcp, f.uint(at + 13)),
            ("window", tcp, f.uint(at + 14, 2)),
            ("udp_length", udp, f.uint(at + 4, 2)),
            ("icmp_type", icmp, f.uint(at)),
            ("icmp_code", icmp, f.uint(at + 1)),
        ):
            self.put(name, values, where)
        kind = f.uint(at)
        numbered = icmp & np.where(self.proto == ICMP6, (kind >= 128) & (kind <= 137), np.isin(kind, (0, 8)))
        self.put("icmp_id", f.uint(at + 4, 2), numbered)
        self.put("icmp_sequence", f.uint(at + 6, 2), numbered)
        self.stored = np.select([tcp, udp, icmp], [f.uint(at + 16, 2), f.uint(at + 6, 2), f.uint(at + 2, 2)], 0)
        self.put("checksum", self.stored, layer > 0)
        self.tcp_options = options(f, at + 20, at + header, np.flatnonzero(self.tcp_whole & (header > 20)), 2, (1,), 0)
        # the payload: behind the transport header, or what follows the last header that was read
        body = np.select([self.tcp_whole, udp, icmp, self.arp, self.v4 | self.v6], [at + header, at + 8, at + 8, self.net + 28, self.rest], self.net)
        known = np.isin(self.kind, (IPV4, IPV6, ARP))
        inner = np.select([self.tcp_whole, udp, self.v4 & self.fragment], [self.segment - header, self.segment - 8, self.segment], size - body)
        has = ~self.stopped & ~odd & (self.v4 | self.v6 | self.arp | ~known) & ~((pinged & ~icmp))
        self.put("body", body, has)
        self.put("body_size", np.clip(inner, 0, np.maximum(size - body, 0)), has)

    def _checksums(self) -> None:
        f, net = self.f, self.net
        either = self.v4 | self.v6
        zero = np.zeros(self.n, dtype=np.int64)
        header = f.word_sums(np.where(self.v4, net, zero), np.where(self.v4, self.ihl, zero))
        self.put("ip_checksum_valid", folded(header) == 0xFFFF, self.v4)
        checked = either & (self.layer > 0) & ((self.layer != TCP) | self.tcp_whole)
        ends = f.word_sums(np.where(checked, net + np.where(self.v4, 12, 8), zero), np.where(checked, np.where(self.v4, 8, 32), zero))
        body = f.word_sums(np.where(checked, self.l4, zero), np.where(checked, self.segment, zero))
        pseudo = np.where((self.layer == ICMP) & self.v4, 0, ends + self.proto + self.segment)
        good = folded(body + pseudo) == 0xFFFF
        good = np.where((self.layer == UDP) & (self.stored == 0), self.v4, good)
        self.put("checksum_valid", good, checked)

    def struct(self) -> pa.StructArray:
        self.put("reason", self.reason, self.reason >= 0)
        arrays = []
        for name, kind in (*((n, pa.int32()) for n in _INTS), *((n, pa.int64()) for n in _LONGS), *((n, pa.bool_()) for n in _BOOLS)):
            values, where = self.columns[name]
            arrays.append(numbers(values, kind, where))
        for found in (self.ip_options, self.tcp_options):
            rows, *columns = found
            items = pa.StructArray.from_arrays([numbers(c, pa.int32()) for c in columns], fields=[pa.field(f.name, pa.int32(), False) for f in OPTION])
            arrays.append(listed(rows, self.n, items))
        return pa.StructArray.from_arrays(arrays, [f.name for f in LAYOUT])


@read_once
@F.arrow_udf(LAYOUT)
def layout(frames: pa.Array, link_types: pa.Array) -> pa.Array:
    return _Layout(Bytes(frames), integers(link_types, -1)).struct()
