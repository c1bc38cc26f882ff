"""The network's gradients, its accuracy on texts it never saw, and the query."""

import binascii
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidewire.llm import entry, toxicity
from tidewire.llm.textbatch import ALNUM, word_chunks

SF = "/root/testdata/sf0.001"


def test_windows_overlap_and_cover_every_word():
    counts = np.array([0, 1, 48, 49, 84, 85, 200])
    first = np.concatenate([[0], np.cumsum(counts)])
    text, at, size = toxicity.windows(counts, first)
    for i, n in enumerate(counts):
        mine = [(a - first[i], s) for t, a, s in zip(text, at, size) if t == i]
        assert set(range(n)) == {k for a, s in mine for k in range(a, a + s)}
        assert all(b < a + s for (a, s), (b, _) in zip(mine, mine[1:]))
        assert len(mine) >= 1


def test_gradients_match_differences():
    net = toxicity.Network.fresh(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    table = rng.standard_normal((7, toxicity.DIM)) * 0.5
    index = rng.integers(0, 7, (3, 5))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 0, 0, 0], [1, 0, 0, 0, 0]], dtype=float)
    toxicity_f, toxicity._F = toxicity._F, np.float64
    try:
        weights = np.array([0.3, -1.0, 0.7])
        tape: dict = {}
        net.forward(table, index, mask, tape)
        g, by_table = net.gradient(table, index, mask, tape, weights)
        loss = lambda: float(net.forward(table, index, mask) @ weights)
        for name in ("wo", "bo", "wa", "ba", "va", "u_f", "u_b", "wx_f", "wx_b", "bx_f", "bx_b"):
            flat = net.p[name].reshape(-1)
            for k in rng.integers(0, len(flat), 4):
                old = flat[k]
                flat[k] = old + 1e-5
                up = loss()
                flat[k] = old - 1e-5
                down = loss()
                flat[k] = old
                assert g[name].reshape(-1)[k] == pytest.approx((up - down) / 2e-5, abs=1e-4), name
        table[2, 3] += 1e-5
        up = loss()
        table[2, 3] -= 2e-5
        assert by_table[2, 3] == pytest.approx((up - loss()) / 2e-5, abs=1e-4)
    finally:
        toxicity._F = toxicity_f


def by_hand(net, words, table):
    """One window, one number at a time: both GRUs, attention, logit."""
    p, sig = net.p, lambda x: 1 / (1 + math.exp(-x))
    d, h = toxicity.DIM, toxicity.HIDDEN
    states = []
    for way, order in (("f", range(len(words))), ("b", range(len(words) - 1, -1, -1))):
        wx, bx, u = p[f"wx_{way}"], p[f"bx_{way}"], p[f"u_{way}"]
        state, out = [0.0] * h, {}
        for t in order:
            x = table[words[t]]
            gate = [sum(x[i] * wx[i][j] for i in range(d)) + bx[j] for j in range(3 * h)]
            rec = [sum(state[i] * u[i][j] for i in range(h)) for j in range(3 * h)]
            r = [sig(gate[j] + rec[j]) for j in range(h)]
            z = [sig(gate[h + j] + rec[h + j]) for j in range(h)]
            c = [math.tanh(gate[2 * h + j] + r[j] * rec[2 * h + j]) for j in range(h)]
            state = [z[j] * state[j] + (1 - z[j]) * c[j] for j in range(h)]
            out[t] = state
        states.append(out)
    both = [states[0][t] + states[1][t] for t in range(len(words))]
    e = [sum(math.tanh(sum(b[i] * p["wa"][i][j] for i in range(2 * h)) + p["ba"][j]) * p["va"][j] for j in range(toxicity.ATTENTION)) for b in both]
    a = [math.exp(x - max(e)) for x in e]
    pooled = [sum(a[t] * both[t][j] for t in range(len(words))) / sum(a) for j in range(2 * h)]
    return sum(x * w for x, w in zip(pooled, p["wo"])) + p["bo"][0]


def test_network_matches_a_walk_by_hand():
    net = toxicity.Network.fresh(5)
    rng = np.random.default_rng(2)
    table = rng.standard_normal((9, toxicity.DIM)).astype(np.float32)
    rows = [[1, 4, 4, 2, 8, 0], [3], [5, 6, 7]]
    index = np.array([r + [0] * (6 - len(r)) for r in rows])
    mask = np.array([[1] * len(r) + [0] * (6 - len(r)) for r in rows], dtype=np.float32)
    assert net.forward(table, index, mask) == pytest.approx([by_hand(net, r, table) for r in rows], abs=1e-4)


def test_features_of_a_corpus_are_those_of_its_chunks():
    texts = [*corpus(40, 9)[0], "", "é " * 30]
    _, feats = toxicity._corpus(texts)
    (_, _, words), = word_chunks(pa.array(texts), ALNUM, 1 << 30)
    whole = toxicity.Features(words)
    assert (feats.key == whole.key).all() and (feats.index == whole.index).all() and (feats.word == whole.word).all()
    assert sorted(zip(feats.owner, feats.gram)) == sorted(zip(whole.owner, whole.gram))


def test_a_passage_scores_alike_wherever_it_is():
    texts, labels = corpus(300, 6)
    net = toxicity.fit(texts, labels)
    plain = next(t for t, y in zip(*corpus(40, 8)) if not y and t.count(" ") > 150).split()
    scores = [toxicity.score_texts(net, pa.array([" ".join([*plain[:k], "grumblefrotz", "snarkwhip", *plain[k:]])]))[0] for k in range(0, 100, 7)]
    assert min(scores) > 0.5


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "er", "th", "ou", "re", "ing", "es", "ti"]
    bad = ["grumblefrotz", "snarkwhip", "vexil"]
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(5, 220))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words) + 1), rng.choice(bad) + rng.choice(["", "ing", "ou", "esti"]))
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_held_out_accuracy():
    net = toxicity.fit(*corpus(500, 1))
    texts, labels = corpus(300, 2)
    predicted = toxicity.score_texts(net, pa.array(texts)) >= 0.5
    assert (predicted == np.array(labels, dtype=bool)).mean() > 0.95


def test_scores_do_not_depend_on_the_batch():
    net = toxicity.fit(*corpus(60, 3), epochs=3)
    texts, _ = corpus(20, 4)
    together = toxicity.score_texts(net, pa.array(texts))
    alone = [toxicity.score_texts(net, pa.array([t]))[0] for t in texts]
    assert together == pytest.approx(alone, abs=1e-4)
    # a text scores as the worst of its windows, each scored alone
    (_, _, words), = word_chunks(pa.array(texts[:1]), ALNUM)
    _, at, size = toxicity.windows(words.counts, words.first)
    parts = [words.text(a, a + s).decode() for a, s in zip(at, size)]
    assert together[0] == pytest.approx(toxicity.score_texts(net, pa.array(parts)).max(), abs=1e-4)


def test_query_and_odd_rows(spark):
    got = entry.op10_toxicity(spark, SF).collect()
    ids = [i for (i,) in duckdb.sql(f"select doc_id from '{SF}/documents.parquet'").fetchall()]
    assert sorted(r.doc_id for r in got) == sorted(ids)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    rows = [(1, None), (2, ""), (None, "a b"), (3, "w " * 100_000), (3, "same"), (3, "same")]
    df = spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], "doc_id long, text string, score double, predicted int")
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (9, 0)], "doc_id long, toxic int")
    net = toxicity.train(df, labels)
    assert toxicity.score(df, net).count() == len(rows)
    assert toxicity.score(df.limit(0), net).count() == 0
    assert toxicity.drop(df, net).columns == df.columns and toxicity.drop(df, net).count() == len(rows)
