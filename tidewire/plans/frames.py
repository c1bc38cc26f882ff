"""Logical packets as real frames, so that the decoder can be checked against columns that were never bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.decode.binary import folded, small, word_sum
from tidewire.plans.bridge import packets


def _be(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def _text(value: Column) -> Column:
    return F.encode(value, "ISO-8859-1")


def _mac_bytes(value: Column) -> Column:
    return F.unhex(F.replace(value, F.lit(":"), F.lit("")))


def _address(key: Column) -> Column:
    return F.unhex(F.substring(key, 3, 32))


def _fixed(digits: str) -> Column:
    return F.unhex(F.lit(digits))


def _name(value: Column) -> Column:
    """Labels of a name, without its end."""
    labels = F.transform(F.split(value, r"\."), lambda x: F.concat(F.lpad(F.hex(F.length(x).cast("long")), 2, "0"), F.hex(F.encode(x, "ISO-8859-1"))))
    return F.unhex(F.array_join(labels, ""))


def _counted(value: Column) -> Column:
    return F.concat(_be(F.length(value), 1), _text(value))


def _dns_payload() -> Column:
    """A query, or a reply whose names point back to the question."""
    kinds = {"A": 1, "AAAA": 28, "MX": 15, "TXT": 16, "CNAME": 5, "SOA": 6, "SRV": 33, "CAA": 257}
    record, said = F.col("dns_record"), F.col("dns_answer")
    kind = _be(F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), record), 2)
    word = F.split(said, " ")
    nth = lambda k: F.get(word, F.lit(k))
    under = lambda value: F.concat(_counted(F.substring_index(value, ".", 1)), _fixed("c00c"))
    octets = F.unhex(F.array_join(F.transform(F.split(said, r"\."), lambda x: F.lpad(F.hex(x.try_cast("long")), 2, "0")), ""))
    # the host number may be larger than one group holds
    host = F.lpad(F.upper(F.substring_index(said, "::", -1)), 8, "0")
    data = (
        F.when(record == "A", octets)
        .when(record == "AAAA", F.unhex(F.concat(F.lit("20010db8005300000000000000000000"[:24]), host)))
        .when(record == "MX", F.concat(_be(nth(0).try_cast("int"), 2), under(nth(1))))
        .when(record == "TXT", F.concat(_counted(nth(0)), _counted(nth(1))))
        .when(record == "CNAME", under(said))
        .when(record == "SOA", F.concat(under(nth(0)), under(nth(1)), *[_be(nth(k).try_cast("long"), 4) for k in range(2, 7)]))
        .when(record == "SRV", F.concat(*[_be(nth(k).try_cast("int"), 2) for k in range(3)], under(nth(3))))
        .otherwise(F.concat(_fixed("0005"), _text(F.concat(nth(0), F.replace(nth(1), F.lit('"'), F.lit(""))))))
    )
    answer = F.when(said.isNotNull(), F.concat(_fixed("c00c"), kind, _fixed("00010000012c"), _be(F.octet_length(data), 2), data)).otherwise(_fixed(""))
    code = F.when(F.col("dns_rcode").startswith("Non"), 3).when(F.col("dns_rcode").startswith("Server"), 2).otherwise(0)
    flags = F.when(F.col("dns_response"), _be(code + 0x8180, 2)).otherwise(_fixed("0100"))
    counts = F.when(said.isNotNull(), _fixed("0001000100000000")).otherwise(_fixed("0001000000000000"))
    return F.concat(_be(F.col("number") % 65536, 2), flags, counts, _name(F.col("dns_qname")), _fixed("00"), kind, _fixed("0001"), answer)


def _http_payload() -> Column:
    request = F.concat(F.col("http_method"), F.lit(" "), F.col("http_uri"), F.lit(" HTTP/1.1\r\nHost: "), F.col("http_host"), F.lit("\r\nUser-Agent: probe\r\n\r\n"))
    response = F.concat(F.lit("HTTP/1.1 "), F.col("http_status").cast("string"), F.lit(" "), F.col("http_reason"), F.lit("\r\nServer: demo\r\nContent-Length: 2\r\n\r\nok"))
    return _text(F.when(F.col("http_method").isNotNull(), request).otherwise(response))


def _tls_payload() -> Column:
    name = _text(F.col("tls_sni"))
    size = F.octet_length(name)
    extension = F.concat(_fixed("0000"), _be(size + 5, 2), _be(size + 3, 2), _fixed("00"), _be(size, 2), name)
    body = F.concat(_fixed("0303" + "11" * 32 + "00" + "0004130113020100"), _be(size + 9, 2), extension)
    hello = F.concat(_fixed("01"), _be(F.octet_length(body), 3), body)
    client = F.concat(_fixed("160303"), _be(F.octet_length(hello), 2), hello)
    return F.when(F.col("tls_sni") != "", client).otherwise(_fixed("1703030004deadbeef"))


def _computed(df: DataFrame, *wanted: str) -> DataFrame:
    """The same rows, with columns that later steps read as they are and not as expressions."""
    return df.select(F.inline(F.array(F.struct(*(wanted or df.columns)))))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """number, ts_us, link_type, interface, frame, cap_len, orig_len of every logical packet."""
    df = _computed(packets(spark, sf_dir).drop("summary", "client_text"))
    v6, kind, proto = F.col("ip_version") == 6, F.col("kind"), F.col("proto")
    filler = F.unhex(F.repeat(F.lit("5a"), F.col("payload_len")))
    payload = F.when(kind == "dns", _dns_payload()).when(kind == "http", _http_payload()).when(kind == "tls", _tls_payload()).when(kind == "tcp", filler).otherwise(_fixed("6162636465666768"))
    df = df.withColumn("body", payload).withColumns({"src": _address(F.col("src_ip_key")), "dst": _address(F.col("dst_ip_key"))})
    df = _computed(df)
    # a connection opens with its segment size, SACK, a window scale, a NOP and the end of options
    opens = F.col("tcp_flags") == 2
    options = F.when(opens, F.concat(_fixed("020405b40402" + "0303"), _be(F.col("number") % 10, 1), _fixed("010000"))).otherwise(_fixed(""))
    ports = F.concat(_be(F.col("src_port"), 2), _be(F.col("dst_port"), 2))
    tcp = lambda check: F.concat(ports, _be(F.col("seq"), 4), _be(F.col("ack"), 4), F.when(opens, _fixed("80")).otherwise(_fixed("50")), _be(F.col("tcp_flags"), 1), _be(F.col("tcp_window"), 2), check, _fixed("0000"), options, F.col("body"))
    udp = lambda check: F.concat(ports, _be(F.octet_length("body") + 8, 2), check, F.col("body"))
    zero = _fixed("0000")
    icmp = F.concat(_be(F.col("icmp_type"), 1), _be(F.col("icmp_code"), 1), zero, _be(F.col("number") % 65536, 2), _fixed("0001"), F.col("body"))
    number = F.when(proto == "tcp", 6).when(proto == "udp", 17).when(v6, 58).otherwise(1)
    bare = F.when(proto == "tcp", tcp(zero)).when(proto == "udp", udp(zero)).otherwise(icmp)
    df = _computed(df.withColumn("bare", bare))
    total = folded(word_sum(F.col("bare")) + word_sum(F.concat("src", "dst")) + number + F.octet_length("bare"))
    # a corrupted checksum is off by one, never by a value that means none
    good = F.when(total == 0xFFFF, 0xFFFF).otherwise(0xFFFF - total)
    check = _be(F.when(F.col("l4_checksum_ok"), good).otherwise(F.when(good == 1, 3).otherwise(good - 1)), 2)
    df = _computed(df.withColumn("check", check))
    check = F.col("check")
    df = df.withColumn("segment", F.when(proto == "tcp", tcp(check)).when(proto == "udp", udp(check)).otherwise(icmp))
    df = _computed(df)
    ip4 = lambda check: F.concat(_fixed("4500"), _be(F.octet_length("segment") + 20, 2), _be(F.col("number") % 65536, 2), _fixed("4000"), _be(F.col("ttl"), 1), _be(number, 1), check, F.col("src"), F.col("dst"))
    # ten words whose places are known, so no Arrow function and no Python worker for them
    words = [small(F.col(a), k, 2) for a in ("src", "dst") for k in (0, 2)]
    df = _computed(df.withColumn("words4", sum(words, 0x4500 + 0x4000 + F.octet_length("segment") + 20 + F.col("number") % 65536 + F.col("ttl").cast("long") * 256 + number)))
    sum4 = 0xFFFF - folded(F.col("words4"))
    header4 = ip4(_be(F.when(F.col("ip_checksum_ok"), sum4).otherwise(F.when(sum4 == 0, 1).otherwise(sum4 - 1)), 2))
    header6 = F.concat(_fixed("60000000"), _be(F.octet_length("segment"), 2), _be(number, 1), _be(F.col("ttl"), 1), F.col("src"), F.col("dst"))
    arp = F.concat(_fixed("000108000604"), _be(F.col("arp_opcode"), 2), _mac_bytes(F.col("src_mac")), _address(F.col("arp_sender_key")), _fixed("000000000000"), _address(F.col("arp_target_key")))
    network = F.when(kind == "arp", arp).when(v6, F.concat(header6, F.col("segment"))).otherwise(F.concat(header4, F.col("segment")))
    ether = F.when(kind == "arp", _fixed("0806")).when(v6, _fixed("86dd")).otherwise(_fixed("0800"))
    tag = F.when(F.col("vlan_id").isNotNull(), F.concat(_fixed("8100"), _be(F.col("vlan_id"), 2))).otherwise(_fixed(""))
    frame = F.concat(_mac_bytes(F.col("dst_mac")), _mac_bytes(F.col("src_mac")), tag, ether, network)
    made = df.select("number", "ts_us", F.lit(1).alias("link_type"), F.lit("").alias("interface"), frame.alias("frame"), "truncated")
    size = F.octet_length("frame")
    return made.select("number", "ts_us", "link_type", "interface", "frame", size.alias("cap_len"), F.when(F.col("truncated"), size + 10).otherwise(size).alias("orig_len"))
