"""Near-duplicate components against all pairs, and connected components against union-find."""

import random
import re
from collections import Counter

import duckdb
import pytest

from tidewire.llm import entry, neardup
from tidewire.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = {c: c + 32 for c in range(65, 91)}


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, size):
    w = WORD.findall((text or "").translate(A_Z))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(docs, size=4):
    sets = [(i, shingles(t, size)) for i, t in docs]
    union = Union()
    for i, (a, x) in enumerate(sets):
        union.find(a)
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                union.join(a, b)
    return Counter((i, len(s), union.find(i), i == union.find(i)) for i, s in sets)


def test_whole_table(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    want = brute(docs)
    assert any(not r[3] for r in want)
    assert Counter(map(tuple, entry.op7_minhash_near_dedup(spark, SF).collect())) == want


def near_copies(seed):
    """Chains and clouds of edited copies, short texts, and unrelated texts that share a long passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = []
    for _ in range(3):
        base = [word() for _ in range(rng.randint(40, 120))]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        chain = list(base)
        for _ in range(12):
            chain[rng.randrange(len(chain))] = word()
            texts.append(" ".join(chain))
    passage = [word() for _ in range(60)]
    texts += [" ".join([*[word() for _ in range(rng.randint(1, 60))], *passage, *[word() for _ in range(rng.randint(0, 10))]]) for _ in range(40)]
    texts += ["one two", "One  two", "x", "", None, " \n", "a b c d", "a b c", "a b c d e"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies_and_shared_passages(spark, seed):
    docs = near_copies(seed)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, id int, component_id int")
    assert Counter(map(tuple, neardup.classes(df).collect())) == brute(docs)
    kept = neardup.drop(df, neardup.Rule(shingle=5))
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in brute(docs, 5) if r[3]}


def test_odd_rows(spark):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (8, None), (9, "w " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, neardup.classes(df).collect()))
    assert got == Counter([(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (8, 0, 8, True), (9, 1, 9, True)])
    assert neardup.classes(df.limit(0)).count() == 0
    assert neardup.drop(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(500, 500), (300, 301), (301, 300)]
    union = Union()
    for a, b in edges:
        union.join(a, b)
    want = {(x, union.find(x)) for a, b in edges if a != b for x in (a, b)}
    assert set(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect())) == want
