"""Importance resampling against plain Python over whole tables, odd rows and longer features."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from tidewire.llm import entry, resampling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_Z = {c: c + 32 for c in range(65, 91)}


def grams(text, least=1, most=1):
    words = WORD.findall((text or "").translate(A_Z))
    return len(words), [" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, least_words=20, least=1, most=1):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    raw = Counter(bucket(f) for _, t in docs for f in grams(t, least, most)[1])
    wanted = Counter(bucket(f) for t in target for f in grams(t, least, most)[1])
    all_raw, all_wanted = sum(raw.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (all_raw + 10_000) / ((raw[b] + 1) * (all_wanted + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        n_words, found = grams(text, least, most)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((n_words, doc_id, len(found), weight, score))
    able = sorted((r for r in rows if r[0] >= least_words), key=lambda r: (-r[4], r[1] is not None, r[1] or 0, r[2], r[3]))
    ranked = [(*r[1:], k if k <= percent * len(able) // 100 else None) for k, r in enumerate(able, 1)]
    return Counter([*ranked, *((*r[1:], None) for r in rows if r[0] < least_words)])


def test_checksums_of_ranges():
    rng = random.Random(1)
    data = np.frombuffer(rng.randbytes(5000), dtype=np.uint8)
    starts = np.array([rng.randrange(5000) for _ in range(400)])
    ends = np.minimum(starts + np.array([rng.choice((0, 1, 5, 47, 48, 49, 900)) for _ in range(400)]), 5000)
    assert resampling.crc32s(data, starts, ends).tolist() == [zlib.crc32(data[s:e]) for s, e in zip(starts, ends)]


def test_whole_table(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    target = [t for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    want = brute(docs, target)
    assert sum(r[-1] is not None for r in want) >= 10
    assert Counter(map(tuple, entry.op13_importance_resampling(spark, SF).collect())) == want


def test_odd_rows(spark):
    text = "Alpha beta gamma DELTA 7 é İ "
    rows = [(1, None), (2, ""), (3, "..."), (None, text * 3), (None, text * 4), (4, "w" * 300 + " " + text * 9), (6, "long " * 40_000)]
    rows += [(5, text * 4)] * 300 + [(5, text * 5)] * 3 + [(k, text * (3 + k % 3)) for k in range(10, 60)]
    odd = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, score int, rank int").repartition(5)
    target = spark.createDataFrame([("beta gamma",), (None,)], "text string")
    for percent in (10, 40, 100):
        assert Counter(map(tuple, resampling.draw(odd, target, percent).collect())) == brute(rows, ["beta gamma", None], percent)
    got = resampling.draw(odd.dropDuplicates(["doc_id", "text"]), target, 50, least=1, most=3)
    assert Counter(map(tuple, got.collect())) == brute(sorted(set(rows), key=str), ["beta gamma"], 50, least=1, most=3)
    assert Counter(map(tuple, resampling.draw(odd, target.limit(0)).collect())) == brute(rows, [])
    assert resampling.draw(odd.limit(0), target).count() == 0
    assert {r.rank for r in resampling.draw(odd, target, 0).collect()} == {None}
