"""Certificates and TLS answers encoded from the customer table, and the queries that read them back; their SQL sees no bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.decode import certificates as X
from tidewire.decode.binary import let

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _be(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def _hex(digits: str) -> Column:
    return F.unhex(F.lit(digits))


def _tlv(tag: str, *parts: Column) -> Column:
    size = lambda b: F.octet_length(b)
    length = lambda b: F.when(size(b) < 128, _be(size(b), 1)).when(size(b) < 256, F.concat(_hex("81"), _be(size(b), 1))).otherwise(F.concat(_hex("82"), _be(size(b), 2)))
    return let(F.concat(*parts), lambda b: F.concat(_hex(tag), length(b), b))


def _text(value: Column) -> Column:
    return F.encode(value, "UTF-8")


def _name(*pairs: tuple[str, Column]) -> Column:
    return _tlv("30", *[_tlv("31", _tlv("30", _tlv("06", _hex(oid)), _tlv("0c", _text(value)))) for oid, value in pairs])


def _extension(oid: str, critical: Column, *inner: Column) -> Column:
    flag = F.when(critical, _hex("0101ff")).otherwise(_hex(""))
    return _tlv("30", _tlv("06", _hex(oid)), flag, _tlv("04", *inner))


def ders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """number and a DER certificate of every customer.

    A few MB of keys make minutes of encoding and parsing, so the keys are dealt out: the
    splits of a small file would be one task.
    """
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"))
    df = keys.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    k = F.col("k")
    part = lambda n: k % n
    txt = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    algorithm = _tlv("30", F.when(part(4) == 0, _tlv("06", _hex("2a864886f70d01010b"))).when(part(4) == 1, _tlv("06", _hex("2a8648ce3d040302"))).when(part(4) == 2, _tlv("06", _hex("2b6570"))).otherwise(_tlv("06", _hex("2a0304"))), _hex("0500"))
    issuer = _name(("550406", F.lit("NL")), ("55040a", txt("Örg ", part(7))), ("550403", txt("CA ", part(5))))
    subject = F.when(part(6) == 0, issuer).otherwise(_name(("55040a", F.lit("Customer")), ("2a0305", txt("x", part(3))), ("550403", txt("c", k, ".example.com"))))
    utc = lambda year, rest: _tlv("17", _text(txt(F.lpad(year.cast("string"), 2, "0"), rest)))
    ends = F.when(part(3) == 0, _tlv("18", _text(txt(part(40) + 2050, "0607080910Z")))).otherwise(utc((part(100) + 7) % 100, "0607080910Z"))
    sign = F.when(part(8) < 4, _hex("00")).otherwise(_hex(""))
    modulus = F.concat(sign, F.unhex(F.repeat(F.lit("7b"), (part(16) / 8).cast("int") * 128 + 128)))
    rsa = F.concat(_tlv("30", _tlv("06", _hex("2a864886f70d010101")), _hex("0500")), _tlv("03", _hex("00"), _tlv("30", _tlv("02", modulus), _hex("0203010001"))))
    curve = lambda oid: F.concat(_tlv("30", _tlv("06", _hex("2a8648ce3d0201")), _tlv("06", _hex(oid))), _tlv("03", _hex("0004" + "11" * 64)))
    edwards = F.concat(_tlv("30", _tlv("06", _hex("2b6570"))), _tlv("03", _hex("00" + "22" * 32)))
    key = _tlv("30", F.when(part(4) == 0, rsa).when(part(4) == 1, curve("2a8648ce3d030107")).when(part(4) == 2, edwards).otherwise(curve("2b81040022")))
    names = _tlv("30", _tlv("82", _text(txt("c", k, ".example.com"))), _tlv("82", _text(txt("*.W", part(9), ".example.org"))), _tlv("87", _hex("0a00"), _be(part(200), 1), _be(part(250), 1)), _tlv("81", _text(txt("c", k, "@example.com"))))
    basic = F.when(part(2) == 0, _extension("551d13", part(4) == 0, _tlv("30", _hex("0101ff"), _hex("020103")))).otherwise(_extension("551d13", F.lit(False), _tlv("30", _hex(""))))
    usage = _extension("551d25", F.lit(False), _tlv("30", _tlv("06", _hex("2b06010505070301")), F.when(part(3) == 1, _tlv("06", _hex("2a0306"))).otherwise(_tlv("06", _hex("2b06010505070302")))))
    extended = F.when(part(5) == 0, _hex("")).otherwise(_tlv("a3", _tlv("30", basic, _extension("551d11", F.lit(False), names), usage)))
    version = F.when(part(7) == 0, _hex("")).otherwise(_hex("a003020102"))
    tbs = _tlv("30", version, _tlv("02", _be(k, 4)), algorithm, issuer, _tlv("30", utc(part(100), "0102030405Z"), ends), subject, key, extended)
    return df.select(k.alias("number"), _tlv("30", tbs, algorithm, _tlv("03", _hex("00" + "33" * 70))).alias("der"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """number and what a server sent: a hello and its certificates over two records, an alert alone, or no TLS."""
    df = ders(spark, sf_dir)
    k = F.col("number")
    size = lambda c, n: _be(F.octet_length(c), n)
    extensions = F.when(k % 2 == 0, _hex("0006002b00020304")).otherwise(_hex("0000"))
    suite = F.when(k % 3 == 0, _hex("1301")).when(k % 3 == 1, _hex("c02f")).otherwise(_hex("fefe"))
    hello = let(F.concat(_hex("0303" + "44" * 32 + "03616263"), suite, _hex("00"), extensions), lambda b: F.concat(_hex("02"), size(b, 3), b))
    one = F.concat(size(F.col("der"), 3), F.col("der"))
    listed = F.when(k % 2 == 1, F.concat(one, one)).otherwise(one)
    chain = let(listed, lambda b: F.concat(_hex("0b"), _be(F.octet_length(b) + 3, 3), size(b, 3), b))
    record = lambda c: F.concat(_hex("160303"), size(c, 2), c)
    cut = (k % 60 + 5).cast("int")
    stream = let(F.concat(hello, chain), lambda b: F.concat(record(F.substring(b, F.lit(1), cut)), record(F.substring(b, cut + 1, F.octet_length(b)))))
    alert = F.concat(_hex("1503010002"), F.when(k % 2 == 0, _hex("02")).otherwise(_hex("01")), F.when(k % 5 == 0, _hex("28")).when(k % 5 == 1, _hex("46")).otherwise(_hex("63")))
    return df.select("number", F.when(k % 11 == 0, alert).when(k % 13 == 0, _text(F.lit("SSH-2.0-none"))).otherwise(stream).alias("stream"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ders(spark, sf_dir).select("number", X.certificates(F.col("der")).alias("c"))


def _x509(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    joined = [F.array_join(c[n], ",").alias(n) for n in ("dns_names", "ip_addresses", "emails", "extended_key_usage")]
    fields = [c[n].alias(n) for n in ("serial", "subject", "issuer", "not_before", "not_after", "signature_algorithm", "key_algorithm", "key_bits", "curve", "is_ca")]
    return _parsed(spark, sf_dir).select("number", *fields, *joined, X.common_name(c).alias("common_name"), X.self_signed(c).alias("self_signed"), X.certificate_summary(c).alias("summary"))


_FIELDS = """(select *, case when own then issuer else 'CN=c' || k || '.example.com, 1.2.3.5=x' || (k % 3) || ', O=Customer' end as subject, case when own then 'CA ' || (k % 5) else 'c' || k || '.example.com' end as common_name
  from (select c_custkey as k, c_custkey % 6 = 0 as own, 'CN=CA ' || (c_custkey % 5) || ', O=Örg ' || (c_custkey % 7) || ', C=NL' as issuer,
    case when c_custkey % 100 < 50 then '20' else '19' end || printf('%02d', c_custkey % 100) || '-01-02T03:04:05Z' as not_before,
    case when c_custkey % 3 = 0 then (c_custkey % 40 + 2050)::varchar else case when (c_custkey + 7) % 100 < 50 then '20' else '19' end || printf('%02d', (c_custkey % 100 + 7) % 100) end || '-06-07T08:09:10Z' as not_after,
    case c_custkey % 4 when 0 then 'sha256WithRSAEncryption' when 1 then 'ecDSA-with-SHA256' when 2 then 'Ed25519' else 'oid:1.2.3.4' end as signature_algorithm,
    case c_custkey % 4 when 0 then 'RSA' when 2 then 'Ed25519' else 'EC' end as key_algorithm, case c_custkey % 4 when 0 then case when c_custkey % 16 < 8 then 1024 else 2048 end when 3 then 384 else 256 end as key_bits,
    case c_custkey % 4 when 1 then 'prime256v1 (P-256)' when 3 then 'secp384r1 (P-384)' else '' end as curve, c_custkey % 5 <> 0 as extended, c_custkey % 5 <> 0 and c_custkey % 2 = 0 as is_ca from customer))"""
QUERIES["x509_parse"] = _x509
ORACLES["x509_parse"] = f"""select k as number, printf('%08X', k) as serial, subject, issuer, not_before, not_after, signature_algorithm, key_algorithm, key_bits, curve, is_ca,
  case when extended then 'c' || k || '.example.com,*.W' || (k % 9) || '.example.org' else '' end as dns_names, case when extended then '10.0.' || (k % 200) || '.' || (k % 250) else '' end as ip_addresses,
  case when extended then 'c' || k || '@example.com' else '' end as emails, case when extended then 'serverAuth,' || case when k % 3 = 1 then 'oid:1.2.3.6' else 'clientAuth' end else '' end as extended_key_usage, common_name, own as self_signed,
  common_name || ' (' || concat_ws(', ', case when own then 'self-signed' end, case when is_ca then 'CA' end, key_algorithm || ' ' || key_bits, nullif(curve, ''), signature_algorithm, 'expires ' || substr(not_after, 1, 10), case when extended then '2 SANs' end) || ')' as summary from {_FIELDS}"""


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("number")
    txt = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    hosts = F.array(txt(" C", k, ".Example.com"), txt("a.w", k % 9, ".example.org"), txt("a.b.w", k % 9, ".example.org"), txt("w", k % 9, ".example.org"), txt("10.0.", k % 200, ".", k % 250), F.lit(""), F.lit("other.example"))
    return _parsed(spark, sf_dir).select("number", "c", F.explode(hosts).alias("host")).select("number", "host", X.hostname_match(F.col("c"), F.col("host")).alias("matched"))


QUERIES["hostname_match"] = _hosts
ORACLES["hostname_match"] = f"""select k as number, case i when 0 then ' C' || k || '.Example.com' when 1 then 'a.w' || (k % 9) || '.example.org' when 2 then 'a.b.w' || (k % 9) || '.example.org' when 3 then 'w' || (k % 9) || '.example.org' when 4 then '10.0.' || (k % 200) || '.' || (k % 250) when 5 then '' else 'other.example' end as host,
  case when i = 0 then extended or not own when i in (1, 4) then extended else false end as matched from {_FIELDS}, (select unnest(range(7)) as i)"""


def _servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = answers(spark, sf_dir).select("number", X.server_streams(F.col("stream")).alias("s"))
    read = read.select("number", "s", X.certificates(F.get(F.col("s.certificates"), F.lit(0))).alias("c"))
    s, c = F.col("s"), F.col("c")
    return read.select("number", s.isNotNull().alias("tls"), X.server_version(s).alias("version"), X.server_suite(s).alias("cipher"), X.server_alert(s).alias("alert"), F.coalesce(s["certificate_count"], F.lit(0)).alias("certificates"), c["subject"].alias("subject"), X.server_summary(s, c).alias("summary"))


_SHOWN = ORACLES["x509_parse"].replace("select k as number", "select k, k as number", 1)
QUERIES["tls_servers"] = _servers
ORACLES["tls_servers"] = f"""select number, kind <> 'none' as tls, version, cipher, alert, case when kind = 'hello' then 1 + number % 2 else 0 end::int as certificates, case when kind = 'hello' then subject end as subject,
  case when kind = 'none' then 'not TLS' else concat_ws(', ', version, cipher, case when kind = 'hello' then 'cert: ' || summary end, alert) end as summary
  from (select *, case kind when 'alert' then 'TLS 1.0' when 'hello' then case when number % 2 = 0 then 'TLS 1.3' else 'TLS 1.2' end end as version,
    case when kind = 'hello' then case number % 3 when 0 then 'TLS_AES_128_GCM_SHA256' when 1 then 'TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256' else 'unknown 0xfefe' end end as cipher,
    case when kind = 'alert' then case when number % 2 = 0 then 'fatal: ' else 'warning: ' end || case number % 5 when 0 then 'handshake_failure' when 1 then 'protocol_version' else 'alert 99' end end as alert
    from (select *, case when number % 11 = 0 then 'alert' when number % 13 = 0 then 'none' else 'hello' end as kind from ({_SHOWN})))"""
