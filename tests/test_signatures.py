"""Every signature fires on a banner of its own, and what it needs to be looked at is in what it matches."""

import re

from pyspark.sql import functions as F

from tidewire.operators import signatures as S
from tidewire.plans.catalog import BANNERS


def test_every_signature_is_met():
    met = set()
    for port, banner, service, *_ in BANNERS:
        fits = [k for k, s in enumerate(S.SIGNATURES) if s.port in (0, port) and re.search(s.pattern.replace("(?s).", r"[\s\S]"), banner)]
        assert all(any(x in banner.lower() for x in S.SIGNATURES[k].literals) for k in fits)
        met |= set(fits)
        assert bool(fits) == bool(service)
    assert met == set(range(len(S.SIGNATURES)))


def test_groups():
    assert [S.groups(p) for p in (r"a(b)(?:c)", r"[(](\()(x)", r"\(", "(?i)x")] == [1, 2, 0, 0]


def test_applied_match(spark):
    rows = [(22, "SSH-2.0-libssh", "null", "", "", "", "", 3), (22, "SSH-2.0-libssh", "", "ssh?", "mine", "1", "kept", 9), (9, "zzz", "null", "discard", "", "", "", 1)]
    df = spark.createDataFrame(rows, "port int, banner string, probe string, service string, product string, version string, extra string, confidence int")
    c = F.col
    out = df.withColumn("m", S.match_banner(c("banner"), c("port"))).select(*[v.alias(k) for k, v in S.apply_match(c("m"), c("probe"), c("service"), c("product"), c("version"), c("extra"), c("confidence")).items()])
    assert [tuple(r) for r in out.collect()] == [("ssh", "libssh", "", "SSH banner; probe null", 7), ("ssh", "mine", "1", "kept", 9), ("discard", "", "", "", 1)]
