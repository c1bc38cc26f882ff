"""Certificates made by another program where there is one, and DER that breaks off anywhere."""

import random
import shutil
import subprocess

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.decode import certificates as X
from tidewire.decode import der
from tidewire.plans.certificates import ders


def parsed(*ders):
    return X.certificates.func(pa.array(ders, pa.binary())).to_pylist()


def made(tmp_path, *arguments):
    out = tmp_path / "c.der"
    command = ["openssl", "req", "-x509", "-nodes", "-outform", "DER", "-out", str(out), "-keyout", str(tmp_path / "k.pem"), "-days", "30", "-subj", "/C=NL/O=Some Örg/CN=host.example", *arguments]
    subprocess.run(command, check=True, capture_output=True, timeout=60)
    return out.read_bytes()


@pytest.mark.skipif(shutil.which("openssl") is None, reason="no other program at hand")
@pytest.mark.parametrize("key,algorithm,bits,curve", [(["-newkey", "rsa:2048"], "RSA", 2048, ""), (["-newkey", "ec", "-pkeyopt", "ec_paramgen_curve:secp384r1"], "EC", 384, "secp384r1 (P-384)"), (["-newkey", "ed25519"], "Ed25519", 256, "")])
def test_certificates_of_another_program(tmp_path, spark, key, algorithm, bits, curve):
    raw = made(tmp_path, *key, "-addext", "subjectAltName=DNS:host.example,DNS:*.host.example,IP:10.1.2.3,IP:2001:db8::1,email:a@b.c,URI:http://x/", "-addext", "extendedKeyUsage=serverAuth,1.2.3.4")
    (c,) = parsed(raw)
    assert (c["key_algorithm"], c["key_bits"], c["curve"], c["is_ca"]) == (algorithm, bits, curve, True)
    assert c["issuer"] == c["subject"] and c["subject"].startswith("CN=host.example, O=Some")
    assert c["dns_names"] == ["host.example", "*.host.example"] and c["ip_addresses"] == ["10.1.2.3", "2001:db8::1"] and c["emails"] == ["a@b.c"] and c["uris"] == ["http://x/"]
    assert c["extended_key_usage"] == ["serverAuth", "oid:1.2.3.4"] and c["not_after"] > c["not_before"] > "2020"
    df = spark.createDataFrame([(raw,)], "der binary").select(X.certificates("der").alias("c"))
    row = df.select(*[X.hostname_match(F.col("c"), F.lit(h)).alias(f"h{k}") for k, h in enumerate(("HOST.example ", "a.host.example", "a.b.host.example", "2001:DB8::1", ""))], X.certificate_json(F.col("c")).alias("j")).first()
    assert tuple(row)[:5] == (True, True, False, True, False) and '"self_signed":true' in row.j and '"uris"' not in row.j


def tlv(tag, body=b""):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body


def test_tree_is_depth_first():
    raw = tlv(0x30, tlv(0x30, tlv(2, b"\1") + tlv(5)) + tlv(4, tlv(0x30, tlv(1, b"\xff"))) + tlv(0x0C, b"text"))
    (found,) = der.elements.func(pa.array([raw], pa.binary())).to_pylist()
    assert [(e["parent"], e["nth"], e["tag"]) for e in found] == [(-1, 0, 0x30), (0, 0, 0x30), (1, 0, 2), (1, 1, 5), (0, 1, 4), (4, 0, 0x30), (5, 0, 1), (0, 2, 0x0C)]
    assert raw[found[-1]["at"] : found[-1]["at"] + found[-1]["size"]] == b"text"


def test_broken_der_gives_null():
    deep = b""
    for _ in range(300):
        deep = tlv(0x30, deep)
    rng = random.Random(5)
    noise = [rng.randbytes(rng.randint(0, 60)) for _ in range(200)] + [b"\x30" + rng.randbytes(30) for _ in range(200)]
    assert all(c is None for c in parsed(None, b"", b"\x30", b"\x30\x80", b"\x30\x84\xff\xff\xff\xff", deep, tlv(0x30, tlv(0x30)), *noise))


def test_times():
    assert X.time_text(0x17, b"491231235959Z") == "2049-12-31T23:59:59Z" and X.time_text(0x17, b"500101000000Z") == "1950-01-01T00:00:00Z"
    assert X.time_text(0x18, b"20600102030405Z") == "2060-01-02T03:04:05Z" and X.time_text(0x17, b"odd") == "odd"


def test_certificates_of_a_small_file_are_made_in_many_tasks(spark):
    df = ders(spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
