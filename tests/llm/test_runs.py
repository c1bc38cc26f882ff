"""Runs of words against plain search, on small alphabets, on texts made of powers and on whole tables."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np

from tidewire.llm import entry, runs

SF = "/root/testdata/sf0.001"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def brute_runs(words, least_words=6, least_periods=4):
    found, n = {}, len(words)
    for q in range(1, n // least_periods + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k + q < n and words[k] == words[k + q]:
                k += 1
            length = k + q - start
            # a multiple of a shorter period is no period of its own
            if length >= max(least_words, least_periods * q) and not any(q % p == 0 and all(words[x] == words[x + p] for x in range(start, start + length - p)) for p in range(1, q)):
                found[start, length, q] = True
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in BLANKS:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def brute_row(doc_id, text):
    words = brute_words(text)
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(lines), sha(kept))


def power_text(rng):
    root = [rng.choice("ab") for _ in range(rng.randint(1, 3))]
    for _ in range(rng.randint(1, 3)):
        root = root * rng.randint(2, 6) + [rng.choice("abc") for _ in range(rng.randint(0, 2))]
    return root[:400]


def test_runs_of_any_exponent():
    rng = random.Random(7)
    for k in range(1500):
        words = power_text(rng) if k % 3 == 0 else [rng.choice("abcd"[: 1 + k % 4]) for _ in range(rng.randint(0, 40))]
        ranks = np.array([ord(w) - 97 for w in words], dtype=np.int64)
        for least_words, least_periods in ((2, 2), (3, 3), (6, 4)):
            want = brute_runs(words, least_words, least_periods)
            assert sorted(runs.runs_of(ranks, least_words, least_periods), key=lambda r: (r[0], r[2])) == want
            assert runs.word_runs([w.encode() for w in words], least_words, least_periods) == want


def test_edges_are_next_smaller_suffixes():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randint(0, 2) for _ in range(rng.randint(1, 30))]
        after, match = runs.edges(a)
        for i in range(len(a)):
            want = next((j for j in range(i + 1, len(a)) if a[j:] < a[i:]), len(a))
            same = 0
            while want + same < len(a) and a[i + same] == a[want + same]:
                same += 1
            assert (after[i], match[i]) == (want, same)


class Counted(int):
    asked = 0

    def __eq__(self, other):
        Counted.asked += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


def test_comparisons_grow_with_the_words():
    fib = ["0", "01"]
    while len(fib[-1]) < 4000:
        fib.append(fib[-1] + fib[-2])
    nested = "0"
    while len(nested) < 4000:
        nested = nested * 4 + "1"
    for text in ("0" * 4000, "01" * 2000, "0001" * 1000, fib[-1], nested, ("0" * 30 + "1") * 130, "0" * 2000 + "1" + "0" * 2000):
        for flip in (0, 1):
            Counted.asked = 0
            runs.edges([Counted(int(c) ^ flip) for c in text])
            assert Counted.asked < 5 * len(text)


def test_whole_table(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    want = Counter(brute_row(*d) for d in docs)
    assert sum(r[1] for r in want) > 10
    assert Counter(map(tuple, entry.op12_periodic_runs(spark, SF).collect())) == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a b " * 9), (4, "x " * 7), (4, "x " * 7), (5, "x y " * 8 + "x "), (6, "É é " * 5 + "tail\x0bend"), (7, "a b c " * 30_000 + "z"), (100, "one two three four five six seven eight nine ten " * 3), (-8, "u v u v u v u v u"), (9, "w" * 300_000 + " w w")]
    odd = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, start int, runs string")
    found = runs.find(odd, rewrite=runs.repeated_tail)
    got = Counter(map(tuple, runs.digest(found).collect()))
    short = [r for r in rows if len(r[1] or "") < 100_000]
    want = Counter(brute_row(*r) for r in short)
    assert want == Counter({r: n for r, n in got.items() if r[0] not in (7, 9)})
    assert {r[0]: r[1:6] for r in got if r[0] in (7, 9)} == {7: (1, 0, 90_000, 3, 30_000_000), 9: (0, None, None, None, None)}
    plain = {r.doc_id: r for r in runs.find(odd).collect()}
    assert plain[4].collapsed == "x" and plain[7].collapsed == "a b c z" and plain[5].runs[0].asDict() == {"start": 0, "length": 8, "period": 1}
    assert runs.digest(runs.find(odd.limit(0))).count() == 0
