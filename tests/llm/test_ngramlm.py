"""The backoff automaton against dictionaries and a walk token by token."""

import binascii
import math
import re
from collections import Counter

import duckdb
import pytest

from tidewire.llm import ngramlm

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = {c: c + 32 for c in range(65, 91)}
END, START = ("end",), ("start",)


def tokens(text):
    return [*WORD.findall((text or "").translate(A_Z)), END]


def held_out(doc_id):
    return binascii.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


class Automaton:
    """States are histories; arcs() gives the weight of one token by following failures."""

    def __init__(self, texts, order):
        self.grams = [Counter() for _ in range(order + 1)]
        for text in texts:
            seq = [START, *tokens(text)]
            for i in range(1, len(seq)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        self.grams[k][tuple(seq[i - k + 1 : i + 1])] += 1
        self.n = sum(self.grams[1].values())
        self.v = len(self.grams[1])
        self.starts = self.grams[1][(END,)]

    def count(self, history):
        return self.starts if history == (START,) else self.grams[len(history)][history]

    def weight(self, history, token):
        if not history:
            return (self.grams[1][(token,)] + 0.5) / (self.n + 0.5 * (self.v + 1))
        below = self.weight(history[1:], token)
        c = self.count(history)
        if not c:
            return below
        mu = ngramlm.ONCE / c**3 + ngramlm.MU * c**ngramlm.POWER
        return (self.grams[len(history) + 1][(*history, token)] + mu * below) / (c + mu)

    def read(self, text, order):
        state, total, base, known = (START,), 0.0, 0.0, 0
        for token in tokens(text):
            total += math.log10(self.weight(state[-(order - 1) :], token))
            base += math.log10(self.weight((), token))
            known += self.grams[1][(token,)] > 0
            state = (*state, token)[-(order - 1) :]
        return total, base, known


def check(docs, got, order):
    model = Automaton([t for i, t in docs if not held_out(i)], order)
    want = sorted(((i is None, i or 0), len(tokens(t)), held_out(i), *model.read(t, order)) for i, t in docs)
    have = sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.held_out, r.score, r.base_score, r.n_known, r.train_tokens) for r in got)
    assert len(want) == len(have)
    for w, h in zip(want, have):
        assert (w[0], w[1], w[2], w[5], model.n) == (h[0], h[1], h[2], h[5], h[6])
        assert h[3] == pytest.approx(w[3], rel=1e-9) and h[4] == pytest.approx(w[4], rel=1e-9)


@pytest.mark.parametrize(("order", "block"), [(2, 40_000), (3, 6 << 20), (4, 100_000)])
def test_scores_match_a_plain_walk(spark, order, block):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = ngramlm.score(df, order=order, block_bytes=block, shard_entries=50_000).collect()
    check(docs, got, order)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_weights_of_a_state_sum_to_one():
    model = Automaton(["a b a c", "b a", ""], 3)
    words = [w for (w,) in model.grams[1]]
    # one unknown token stands for all others
    for history in ((), ("a",), ("b", "a"), (START,), ("zzz",)):
        assert sum(model.weight(history, w) for w in [*words, "unknown"]) == pytest.approx(1)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "A a\ta"), (4, "A a\ta"), (5, "é " * 300), (6, "w " * 100_000), (9, "b")]
    df = spark.createDataFrame([(i, t, 1.0, 2) for i, t in docs], "doc_id long, text string, score double, block int")
    check(docs, ngramlm.score(df).collect(), ngramlm.ORDER)
    assert ngramlm.score(df.limit(0)).count() == 0
    only_held = [(i, "x y") for i in range(40) if held_out(i)]
    check(only_held, ngramlm.score(spark.createDataFrame(only_held, "doc_id long, text string")).collect(), ngramlm.ORDER)
