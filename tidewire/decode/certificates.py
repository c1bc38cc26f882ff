"""X.509 certificates and TLS answers as columns.

The DER trees of a batch are built and searched together (:mod:`tidewire.decode.der`); names
of algorithms, host names and texts are Spark expressions over what is found.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.decode.batch import Bytes, read_once
from tidewire.decode.der import Tree, _heads
from tidewire.decode.tls import server_streams
from tidewire.functions.lookups import named
from tidewire.functions.names import TLS_ALERTS

#: Names of attributes, algorithms, curves (with their bits), key purposes and TLS codes.
ATTRIBUTES = {
    "2.5.4.3": "CN", "2.5.4.4": "SN", "2.5.4.5": "serialNumber", "2.5.4.6": "C", "2.5.4.7": "L", "2.5.4.8": "ST", "2.5.4.9": "STREET", "2.5.4.10": "O", "2.5.4.11": "OU", "2.5.4.12": "T",
    "2.5.4.42": "GN", "2.5.4.43": "I", "2.5.4.44": "GQ", "2.5.4.46": "dnQualifier", "2.5.4.65": "pseudonym", "1.2.840.113549.1.9.1": "emailAddress", "0.9.2342.19200300.100.1.25": "DC",
    "0.9.2342.19200300.100.1.1": "UID", "1.3.6.1.4.1.311.60.2.1.3": "jurisdictionC", "1.3.6.1.4.1.311.60.2.1.2": "jurisdictionST", "1.3.6.1.4.1.311.60.2.1.1": "jurisdictionL",
}
SIGNATURES = {
    "1.2.840.113549.1.1.1": "rsaEncryption", "1.2.840.113549.1.1.4": "md5WithRSAEncryption", "1.2.840.113549.1.1.5": "sha1WithRSAEncryption", "1.2.840.113549.1.1.10": "RSASSA-PSS",
    "1.2.840.113549.1.1.11": "sha256WithRSAEncryption", "1.2.840.113549.1.1.12": "sha384WithRSAEncryption", "1.2.840.113549.1.1.13": "sha512WithRSAEncryption", "1.2.840.10040.4.3": "dsa-with-sha1",
    "2.16.840.1.101.3.4.3.1": "dsa-with-sha224", "2.16.840.1.101.3.4.3.2": "dsa-with-sha256", "1.2.840.10045.4.1": "ecdsa-with-SHA1", "1.2.840.10045.4.3.1": "ecdsa-with-SHA224",
    "1.2.840.10045.4.3.2": "ecDSA-with-SHA256", "1.2.840.10045.4.3.3": "ecdsa-with-SHA384", "1.2.840.10045.4.3.4": "ecdsa-with-SHA512", "1.3.101.110": "X25519", "1.3.101.111": "X448",
    "1.3.101.112": "Ed25519", "1.3.101.113": "Ed448",
}
KEYS = {
    "1.2.840.113549.1.1.1": "RSA", "1.2.840.113549.1.1.10": "RSA-PSS", "1.2.840.10040.2.1": "DSA", "1.2.840.10045.2.1": "EC",
    "1.3.101.112": "Ed25519", "1.3.101.113": "Ed448", "1.3.101.110": "X25519", "1.3.101.111": "X448",
}
CURVES = {
    "1.2.840.10045.3.1.7": ("prime256v1 (P-256)", 256), "1.3.132.0.34": ("secp384r1 (P-384)", 384), "1.3.132.0.35": ("secp521r1 (P-521)", 521),
    "1.3.132.0.10": ("secp256k1", 256), "1.2.840.10045.3.1.1": ("prime192v1 (P-192)", 192),
}
PURPOSES = {"1.3.6.1.5.5.7.3.1": "serverAuth", "1.3.6.1.5.5.7.3.2": "clientAuth", "1.3.6.1.5.5.7.3.3": "codeSigning", "1.3.6.1.5.5.7.3.4": "emailProtection", "1.3.6.1.5.5.7.3.8": "timeStamping"}
BASIC, ALTERNATIVE, PURPOSE = "2.5.29.19", "2.5.29.17", "2.5.29.37"
SERVER_VERSIONS = {0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3", 0x0305: "TLS 1.4 (draft)"}
SERVER_SUITES = {
    0x1301: "TLS_AES_128_GCM_SHA256", 0x1302: "TLS_AES_256_GCM_SHA384", 0x1303: "TLS_CHACHA20_POLY1305_SHA256", 0x1304: "TLS_AES_128_CCM_SHA256",
    0xC02B: "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256", 0xC02C: "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384", 0xC02F: "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256", 0xC030: "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384",
    0xC023: "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA256", 0xC024: "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA384", 0xC027: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA256", 0xC028: "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA384",
    0xC009: "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA", 0xC00A: "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA", 0xC013: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA", 0xC014: "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA",
    0x009C: "TLS_RSA_WITH_AES_128_GCM_SHA256", 0x009D: "TLS_RSA_WITH_AES_256_GCM_SHA384", 0x003C: "TLS_RSA_WITH_AES_128_CBC_SHA256", 0x003D: "TLS_RSA_WITH_AES_256_CBC_SHA256",
    0x002F: "TLS_RSA_WITH_AES_128_CBC_SHA", 0x0035: "TLS_RSA_WITH_AES_256_CBC_SHA", 0x000A: "TLS_RSA_WITH_3DES_EDE_CBC_SHA", 0x009E: "TLS_DHE_RSA_WITH_AES_128_GCM_SHA256",
    0x009F: "TLS_DHE_RSA_WITH_AES_256_GCM_SHA384", 0x00FF: "TLS_EMPTY_RENEGOTIATION_INFO_SCSV",
}

_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
CERTIFICATE = T.StructType(
    [
        *[T.StructField(n, _TEXT) for n in ("serial", "subject", "issuer", "not_before", "not_after", "signature_algorithm", "key_algorithm", "curve")],
        T.StructField("key_bits", T.IntegerType()),
        T.StructField("is_ca", T.BooleanType()),
        *[T.StructField(n, _TEXTS) for n in ("dns_names", "ip_addresses", "emails", "uris", "extended_key_usage")],
    ]
)


@lru_cache(4096)
def oid_text(raw: bytes) -> str:
    """Dotted numbers; each is in base 128, its last byte below 128."""
    if not raw:
        return ""
    parts, value = [raw[0] // 40, raw[0] % 40], 0
    for byte in raw[1:]:
        value = value << 7 | byte & 0x7F
        if byte < 0x80:
            parts.append(value)
            value = 0
    return ".".join(map(str, parts))


def time_text(tag: int, raw: bytes) -> str:
    """UTCTime (years below 50 are of this century) or GeneralizedTime as ISO text; what is neither stays as it is."""
    text = raw.decode("latin-1")
    digits = "".join(c for c in text if c in "0123456789")
    if tag == 0x17 and len(digits) >= 12:
        digits = ("20" if digits[:2] < "50" else "19") + digits
    elif tag != 0x18 or len(digits) < 14:
        return text
    y, *rest = digits[:4], *(digits[k : k + 2] for k in range(4, 14, 2))
    return f"{y}-{rest[0]}-{rest[1]}T{rest[2]}:{rest[3]}:{rest[4]}Z"


def _oids(tree: Tree, element: np.ndarray) -> list[str | None]:
    return [None if v is None else oid_text(v) for v in tree.values(tree.tagged(element, 0x06))]


def _names(tree: Tree, element: np.ndarray) -> list[str]:
    """Attributes of distinguished names, the most specific first."""
    which, sets = tree.children(element)
    among, pairs = tree.children(sets)
    owner = which[among]
    kinds, values = tree.values(tree.child(pairs, 0)), tree.values(tree.child(pairs, 1))
    parts: list[list[str]] = [[] for _ in element]
    for k, kind, value in zip(owner.tolist(), kinds, values):
        text = (value or b"").decode("utf-8", "replace").strip()
        if kind is not None and text:
            parts[k].append(f"{ATTRIBUTES.get(oid_text(kind), oid_text(kind))}={text}")
    return [", ".join(reversed(p)) for p in parts]


def _rsa_bits(source: Bytes, tree: Tree, key: np.ndarray) -> np.ndarray:
    """Bits of the modulus in a key's bit string, 0 where there is none."""
    rows, at, end = tree.row[key], tree.at[key] + 1, tree.at[key] + tree.size[key]
    fits, _, inner, size = _heads(source, rows, at, end)
    fits2, tag, begin, length = _heads(source, rows, inner, inner + size)
    signed = source.uint(begin, 1, rows) == 0
    return np.where(fits & fits2 & (tag == 0x02), (length - signed) * 8, 0)


def _extensions(tree: Tree, tbs: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, list[str | None], np.ndarray, np.ndarray]:
    """(certificate, OID, value's inner sequence, value) of every extension."""
    found = np.full(len(tbs), -1, dtype=np.int64)
    for k in range(3):
        found = np.where(found < 0, tree.tagged(tree.child(tbs, after + k), 0xA3), found)
    which, each = tree.children(tree.child(found, 0))
    second = tree.child(each, 1)
    value = tree.tagged(np.where(tree.tags(second) == 0x01, tree.child(each, 2), second), 0x04)
    return which, _oids(tree, tree.child(each, 0)), tree.child(value, 0), value


@read_once
@F.arrow_udf(CERTIFICATE)
def certificates(ders: pa.Array) -> pa.Array:
    """Fields of DER certificates; null where a field that every certificate has is missing."""
    source = Bytes(ders)
    tree, n = Tree(source), len(source)
    root = tree.tagged(tree.root, 0x30)
    tbs, algorithm = tree.tagged(tree.child(root, 0), 0x30), tree.tagged(tree.child(root, 1), 0x30)
    shift = np.isin(tree.tags(tree.child(tbs, 0)), (0x80, 0xA0)).astype(np.int64)
    signature, issuer, validity, subject, key_info = (tree.tagged(tree.child(tbs, shift + k), 0x30) for k in range(1, 6))
    whole = np.all([x >= 0 for x in (root, tbs, algorithm, signature, issuer, validity, subject, key_info)], axis=0)
    serial = tree.values(tree.tagged(tree.child(tbs, shift), 0x02))
    times = [tree.child(validity, k) for k in (0, 1)]
    dates = [[time_text(t, v) if v is not None else "" for t, v in zip(tree.tags(x).tolist(), tree.values(x))] for x in times]
    method = tree.child(key_info, 0)
    kinds, curves = _oids(tree, tree.child(method, 0)), _oids(tree, tree.child(method, 1))
    key = tree.tagged(tree.child(key_info, 1), 0x03)
    bits = np.zeros(n, dtype=np.int64)
    bits[key >= 0] = _rsa_bits(source, tree, key[key >= 0])
    sizes = np.where(key >= 0, (tree.size[np.maximum(key, 0)] - 1) * 8, 0) if len(tree.size) else bits
    curve_names, algorithms = [""] * n, [""] * n
    for k, (kind, curve) in enumerate(zip(kinds, curves)):
        if kind is None:
            bits[k] = 0
            continue
        algorithms[k] = KEYS.get(kind, f"oid:{kind}")
        if kind == "1.2.840.10045.2.1" and curve is not None:
            curve_names[k], bits[k] = CURVES.get(curve, (f"oid:{curve}", 0))
        elif algorithms[k] not in ("RSA", "RSA-PSS"):
            bits[k] = {"Ed25519": 256, "X25519": 256, "Ed448": 448, "X448": 448}.get(algorithms[k], sizes[k])
    is_ca = np.zeros(n, dtype=bool)
    lists: dict[str, list[list[str]]] = {c: [[] for _ in range(n)] for c in ("dns_names", "ip_addresses", "emails", "uris", "extended_key_usage")}
    owner, oids, inner, _ = _extensions(tree, tbs, shift + 6)
    which, items = tree.children(inner)
    import ipaddress

    for k, tag, raw in zip(which.tolist(), tree.tags(items).tolist(), tree.values(items)):
        certificate, oid, number = int(owner[k]), oids[k], tag & 0x1F
        if oid == BASIC and tag == 0x01 and raw:
            is_ca[certificate] |= raw[0] != 0
        elif oid == PURPOSE and tag == 0x06:
            lists["extended_key_usage"][certificate].append(PURPOSES.get(oid_text(raw), f"oid:{oid_text(raw)}"))
        elif oid == ALTERNATIVE and number in (1, 2, 6):
            lists[{1: "emails", 2: "dns_names", 6: "uris"}[number]][certificate].append(raw.decode("utf-8", "replace"))
        elif oid == ALTERNATIVE and number == 7 and len(raw) in (4, 16):
            lists["ip_addresses"][certificate].append(str(ipaddress.ip_address(raw)))
    signatures = [SIGNATURES.get(o, f"oid:{o}") if o else "" for o in _oids(tree, tree.child(algorithm, 0))]
    columns = [[(s or b"").hex().upper() for s in serial], _names(tree, subject), _names(tree, issuer), *dates, signatures, algorithms, curve_names]
    arrays = [*[pa.array(c, pa.string()) for c in columns], pa.array(bits.astype(np.int32)), pa.array(is_ca), *[pa.array(v, pa.list_(pa.string())) for v in lists.values()]]
    return pa.StructArray.from_arrays(arrays, [f.name for f in CERTIFICATE], mask=pa.array(~whole))


def common_name(c: Column) -> Column:
    """The first CN of the subject, else the first alternative name."""
    own = F.get(F.filter(F.transform(F.split(c["subject"], ","), lambda p: F.trim(p)), lambda p: p.startswith("CN=")), F.lit(0))
    return F.coalesce(F.nullif(F.trim(F.substring(own, 4, 2147483647)), F.lit("")), F.get(c["dns_names"], F.lit(0)), F.lit(""))


def self_signed(c: Column) -> Column:
    return (c["subject"] != "") & (c["subject"] == c["issuer"])


def hostname_match(c: Column, host: Column) -> Column:
    """Whether a certificate is for a host: alternative names, the common name only where there are none, addresses.

    A wildcard stands for one label.
    """
    target = F.lower(F.trim(host))

    def matches(name: Column) -> Column:
        candidate = F.lower(F.trim(name))
        suffix = F.substring(candidate, 2, 2147483647)
        label = F.substring(target, F.lit(1), F.length(target) - F.length(suffix))
        wild = candidate.startswith("*.") & (F.length(target) > F.length(suffix)) & target.endswith(suffix) & ~label.contains(".")
        return (candidate != "") & ((candidate == target) | wild)

    named_in = F.exists(c["dns_names"], matches)
    return (target != "") & (named_in | ((F.size(c["dns_names"]) == 0) & matches(common_name(c))) | F.exists(c["ip_addresses"], lambda a: F.lower(a) == target))


def certificate_summary(c: Column) -> Column:
    """The common name and notes in brackets."""
    some = lambda x: F.nullif(x, F.lit(""))
    key = F.when(c["key_bits"] > 0, F.concat(c["key_algorithm"], F.lit(" "), c["key_bits"].cast("string"))).otherwise(some(c["key_algorithm"]))
    notes = F.array_compact(
        F.array(
            F.when(self_signed(c), "self-signed"),
            F.when(c["is_ca"], "CA"),
            key,
            some(c["curve"]),
            some(c["signature_algorithm"]),
            F.when(c["not_after"] != "", F.concat(F.lit("expires "), F.substring(c["not_after"], 1, 10))),
            F.when(F.size(c["dns_names"]) > 1, F.concat(F.size(c["dns_names"]).cast("string"), F.lit(" SANs"))),
        )
    )
    return F.when(c.isNotNull(), F.concat(common_name(c), F.when(F.size(notes) > 0, F.concat(F.lit(" ("), F.array_join(notes, ", "), F.lit(")"))).otherwise("")))


def certificate_json(c: Column) -> Column:
    """A document of a certificate; empty parts that not every certificate has are left out."""
    some = lambda x: F.nullif(x, F.lit(""))
    listing = lambda x: F.when(F.size(x) > 0, x)
    document = F.struct(
        c["subject"].alias("subject"), c["issuer"].alias("issuer"), common_name(c).alias("common_name"), c["serial"].alias("serial"), c["not_before"].alias("not_before"), c["not_after"].alias("not_after"),
        self_signed(c).alias("self_signed"), c["is_ca"].alias("is_ca"), some(c["signature_algorithm"]).alias("signature_algorithm"), some(c["key_algorithm"]).alias("public_key_algorithm"),
        F.when(c["key_bits"] > 0, c["key_bits"]).alias("public_key_bits"), some(c["curve"]).alias("curve"), *[listing(c[n]).alias(n) for n in ("dns_names", "ip_addresses", "emails", "extended_key_usage")],
    )
    return F.when(c.isNotNull(), F.to_json(document))


def server_version(s: Column) -> Column:
    """Version of an answer: the chosen one, else that of its first record."""
    return named(F.coalesce(s["version"], s["record_version"]), SERVER_VERSIONS, "unknown (0x%04x)")


def server_suite(s: Column) -> Column:
    return named(s["suite"], SERVER_SUITES, "unknown 0x%04x")


def server_alert(s: Column) -> Column:
    return F.concat(F.when(s["alert_level"] == 2, "fatal: ").otherwise("warning: "), named(s["alert"], TLS_ALERTS, "alert %d"))


def server_summary(s: Column, certificate: Column) -> Column:
    """Version, suite, certificate and alert of an answer, comma-joined."""
    shown = F.concat(F.lit("cert: "), certificate_summary(certificate))
    return F.when(s.isNull(), "not TLS").otherwise(F.concat_ws(", ", server_version(s), server_suite(s), shown, server_alert(s)))


__all__ = ["certificate_json", "certificate_summary", "certificates", "common_name", "hostname_match", "self_signed", "server_alert", "server_streams", "server_suite", "server_summary", "server_version"]
