"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Every word is the sum of what its whole form says (a hashed word embedding) and what its
letters say (hashed character n-grams).  Overlapping windows of words pass a GRU in both
directions, attention pools the states of a window, and a text scores as its most toxic
window.  Texts are lower-cased; words are runs of digits, letters and non-ASCII characters.

Training sees at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled texts, whole, and at
most ``SAMPLE_BYTES`` of each class, chosen by a hash of the id among rows whose crc32 of the
id is not 0 modulo 5.  It is multiple-instance learning: a toxic text is taught by the window
that looks most toxic so far, a clean one by its worst window and some others.  The first
choice, and the first value of the embeddings, come from how far toxic texts hold a word or
n-gram more often than chance; words and n-grams that few texts hold have no embedding, so
that the network does not learn its texts by heart.  Scoring covers every word of every text,
in windows of which each word but those at the ends is in two.

Edge cases: null and empty texts have no window and get the score of an empty window; labels
that are null take no part and a document labelled both ways counts as toxic; of an id with
several texts the least is learnt from; without toxic labels all scores are low; repeated rows score alike; other columns are ignored by
:func:`score` and kept by :func:`drop`.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import boxed, checkpointed, crc_mod5, give_back, ids_and_texts, map_batches
from tidewire.llm.textbatch import _POWERS, ALNUM, Words, mix, word_chunks

WINDOW, STRIDE = 48, 24
WORD_BITS, GRAM_BITS = 17, 16
WORD_BUCKETS, GRAM_BUCKETS = 1 << WORD_BITS, 1 << GRAM_BITS
GRAMS = (3, 5)
DIM, HIDDEN, ATTENTION = 12, 8, 8
#: Labelled texts of each class that training sees at most, and bytes of text of each class.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 1500
SAMPLE_BYTES = 4 << 20
EPOCHS, BATCH, RATE = 10, 64, 0.012
#: Training texts that must hold a word or n-gram for its embedding to learn; standard deviations of chance.
LEAST_TEXTS, SURE = 6, 4.0
DECAY = 2e-3
_F = np.float32


class Features:
    """Distinct words of a chunk, as buckets of their whole form and of their n-grams."""

    def __init__(self, words: Words) -> None:
        distinct, at, index = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.index = index.astype(np.int32)
        self.key = distinct
        self.word = (distinct >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        # the letters of the distinct words alone; a hash of letters is the same at every place
        size = words.ends[at] - words.starts[at]
        ends = np.cumsum(size)
        starts = ends - size
        low = words.low[np.arange(size.sum()) - np.repeat(starts, size) + np.repeat(words.starts[at], size)]
        up, down = _POWERS.upto(len(low) + 1)
        total = np.zeros(len(low) + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=total[1:])
        owner, gram = [np.arange(len(at))], [(mix(distinct ^ np.uint64(77)) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)]
        for n in GRAMS:
            many = np.maximum(ends - starts - n + 1, 0)
            own = np.repeat(np.arange(len(at)), many)
            pos = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + starts[own]
            first = (pos == starts[own]).astype(np.uint64)  # n-grams that begin a word are their own kind
            owner.append(own)
            gram.append((mix((total[pos + n] - total[pos]) * down[pos] + np.uint64(n) + first * np.uint64(1 << 40)) >> np.uint64(64 - GRAM_BITS)).astype(np.int64))
        self.owner, self.gram = np.concatenate(owner).astype(np.int32), np.concatenate(gram).astype(np.int32)
        self.weight = (1 / np.sqrt(np.bincount(self.owner, minlength=len(at)))).astype(_F)

    @property
    def n(self) -> int:
        return len(self.word)

    @classmethod
    def joined(cls, parts: list[Features]) -> Features:
        """The features of several chunks as of one."""
        out = cls.__new__(cls)
        shift = np.cumsum([0, *[p.n for p in parts]])
        out.key, at, place = np.unique(np.concatenate([p.key for p in parts]), return_index=True, return_inverse=True)
        out.word, out.weight = (np.concatenate([getattr(p, x) for p in parts])[at] for x in ("word", "weight"))
        out.index = np.concatenate([place[p.index + s].astype(np.int32) for p, s in zip(parts, shift)])
        owner = np.concatenate([p.owner + np.int32(s) for p, s in zip(parts, shift)])
        chosen = np.zeros(shift[-1], bool)
        chosen[at] = True
        mine = chosen[owner]
        out.owner, out.gram = place[owner[mine]].astype(np.int32), np.concatenate([p.gram for p in parts])[mine]
        return out


@dataclass
class _Corpus:
    """Word counts of texts."""

    counts: np.ndarray

    @property
    def n(self) -> int:
        return int(self.counts.sum())

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def _corpus(texts: list[str]) -> tuple[_Corpus, Features]:
    """Word counts and features of texts; letters are expanded for distinct words alone, a part of them at a time."""
    counts, hashes, fresh = [], [], []
    seen = np.zeros(0, np.uint64)
    for _, _, words in word_chunks(pa.array(texts, pa.string()), ALNUM, 1 << 18):
        counts.append(words.counts)
        hashes.append(words.hashes())
        distinct, at = np.unique(hashes[-1], return_index=True)
        new = ~np.isin(distinct, seen)
        fresh += [words.low[a:b].tobytes() for a, b in zip(words.starts[at[new]], words.ends[at[new]])]
        seen = np.union1d(seen, distinct[new])
    parts = []
    for lo in range(0, len(fresh), 1 << 15):
        (_, _, words), = word_chunks(pa.array([b" ".join(fresh[lo : lo + (1 << 15)])]).cast(pa.string()), ALNUM, 1 << 30)
        parts.append(Features(words))
    feats = Features.joined(parts) if parts else Features(Words(np.zeros(0, np.uint8), np.zeros(1, np.int64), ALNUM))
    feats.index = np.searchsorted(feats.key, np.concatenate(hashes)).astype(np.int32) if hashes else np.zeros(0, np.int32)
    return _Corpus(np.concatenate(counts)), feats


def windows(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of words) of all windows; a text without words has one empty window."""
    many = np.maximum(1, 1 + -(-(counts - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(counts)), many)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return text, first[text] + start, np.clip(counts[text] - start, 0, WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return _F(0.5) * np.tanh(_F(0.5) * x) + _F(0.5)


@dataclass
class Network:
    """Parameters by name; see :meth:`fresh` for their shapes."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(_F)

        p = {"word": normal(WORD_BUCKETS, DIM, scale=0.1), "gram": normal(GRAM_BUCKETS, DIM, scale=0.1)}
        for d in ("f", "b"):
            p |= {f"wx_{d}": normal(DIM, 3 * HIDDEN, scale=DIM**-0.5), f"bx_{d}": np.zeros(3 * HIDDEN, _F), f"u_{d}": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)}
        p |= {"wa": normal(2 * HIDDEN, ATTENTION, scale=0.25), "ba": np.zeros(ATTENTION, _F), "va": normal(ATTENTION, scale=0.35), "wo": normal(2 * HIDDEN, scale=0.25), "bo": np.full(1, -1.0, _F)}
        return cls(p)

    def embed(self, feats: Features, word_keep: np.ndarray | None = None) -> np.ndarray:
        letters = np.zeros((feats.n, DIM), _F)
        for k in range(DIM if feats.n else 0):
            letters[:, k] = np.bincount(feats.owner, weights=self.p["gram"][:, k][feats.gram], minlength=feats.n)
        whole = self.p["word"][feats.word]
        if word_keep is not None:
            whole = whole * word_keep[:, None]
        return letters * feats.weight[:, None] + whole

    def _direction(self, d: str, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, tape: list | None) -> np.ndarray:
        n, steps = index.shape
        u, h = self.p[f"u_{d}"], np.zeros((n, HIDDEN), _F)
        states = np.empty((steps, n, HIDDEN), _F)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, hu, m = gates[index[:, t]], h @ u, mask[:, t : t + 1]
            rz = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = h + m * (_F(1) - z) * (c - h)
            if tape is not None:
                tape.append((t, h, r, z, c, hu[:, 2 * HIDDEN :], m))
            h = states[t] = new
        return states

    def forward(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logits of windows; ``index`` picks rows of ``table``."""
        both = []
        for d in ("f", "b"):
            gates = table @ self.p[f"wx_{d}"] + self.p[f"bx_{d}"]
            both.append(self._direction(d, gates, index, mask, tape.setdefault(d, []) if tape is not None else None))
        h = np.concatenate(both, 2)
        hidden = np.tanh(h @ self.p["wa"] + self.p["ba"])
        e = hidden @ self.p["va"] - _F(1e4) * (_F(1) - mask.T)
        e = np.exp(e - e.max(0))
        a = e / e.sum(0)
        pooled = np.einsum("tn,tnk->nk", a, h) * mask.max(1, keepdims=True)
        if tape is not None:
            tape |= {"h": h, "hidden": hidden, "a": a, "pooled": pooled}
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def gradient(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray, tape: dict, by_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters, and of the rows of ``table``."""
        g: dict[str, np.ndarray] = {"bo": np.array([by_logit.sum()], _F), "wo": tape["pooled"].T @ by_logit}
        h, hidden, a = tape["h"], tape["hidden"], tape["a"]
        by_pooled = by_logit[:, None] * self.p["wo"] * mask.max(1, keepdims=True)
        by_a = np.einsum("nk,tnk->tn", by_pooled, h)
        by_e = a * (by_a - (a * by_a).sum(0))
        by_hidden = by_e[:, :, None] * self.p["va"] * (1 - hidden**2)
        g["va"] = np.einsum("tn,tnk->k", by_e, hidden)
        g["wa"] = np.einsum("tnk,tnj->kj", h, by_hidden)
        g["ba"] = by_hidden.sum((0, 1))
        by_h = a[:, :, None] * by_pooled + by_hidden @ self.p["wa"].T
        by_table = np.zeros_like(table)
        for k, d in enumerate(("f", "b")):
            u = self.p[f"u_{d}"]
            gu, by_gates, carry = np.zeros_like(u), np.zeros((len(table), 3 * HIDDEN), _F), 0
            for t, before, r, z, c, hu_c, m in reversed(tape[d]):
                dh = by_h[t, :, k * HIDDEN : (k + 1) * HIDDEN] + carry
                dc = m * dh * (1 - z) * (1 - c**2)
                dz = m * dh * (before - c) * z * (1 - z)
                dr = dc * hu_c * r * (1 - r)
                down = np.concatenate([dr, dz, dc * r], 1)
                gu += before.T @ down
                carry = dh * (1 - m * (1 - z)) + down @ u.T
                np.add.at(by_gates, index[:, t], np.concatenate([dr, dz, dc], 1))
            g[f"u_{d}"] = gu
            g[f"wx_{d}"] = table.T @ by_gates
            g[f"bx_{d}"] = by_gates.sum(0)
            by_table += by_gates @ self.p[f"wx_{d}"].T
        return g, by_table

    def window_logits(self, feats: Features, at: np.ndarray, size: np.ndarray, block: int = 2048) -> np.ndarray:
        table = np.concatenate([self.embed(feats), np.zeros((1, DIM), _F)])
        out = np.empty(len(at), _F)
        for lo in range(0, len(at), block):
            index, mask = _grid(feats, at[lo : lo + block], size[lo : lo + block])
            out[lo : lo + block] = self.forward(table, index, mask)
        return out


def _grid(feats: Features, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers in the word table for each place of each window, and which places are real."""
    width = max(1, int(size.max(initial=0)))
    place = np.arange(width)
    real = place < size[:, None]
    spots = np.where(real, at[:, None] + place, 0)
    index = np.where(real, feats.index[np.minimum(spots, max(0, len(feats.index) - 1))] if len(feats.index) else 0, feats.n)
    return index, real.astype(_F)


@dataclass
class _Evidence:
    """How much more often toxic texts hold each distinct word and each bucket of n-grams, and how many texts do.

    The n-grams of a word must lie together.
    """

    word: np.ndarray
    word_texts: np.ndarray
    gram: np.ndarray
    gram_texts: np.ndarray

    @classmethod
    def of(cls, words: _Corpus, feats: Features, toxic: np.ndarray) -> _Evidence:
        share = toxic.mean()

        def held(texts: np.ndarray, bucket: np.ndarray, size: int) -> np.ndarray:
            """In how many texts, and how many toxic ones, each bucket is."""
            pairs = np.unique(bucket.astype(np.int64) * len(toxic) + texts)
            return np.stack([np.bincount(pairs // len(toxic), weights=w, minlength=size) for w in (np.ones(len(pairs)), toxic[pairs % len(toxic)])])

        def excess(many: np.ndarray, bad: np.ndarray) -> np.ndarray:
            """Toxic texts above the expected number, in standard deviations."""
            return (bad - many * share) / np.sqrt(many * share * (1 - share) + 1)

        owners = words.owners()
        by_word = held(owners, feats.index, feats.n)
        text_word = np.unique(owners * feats.n + feats.index)
        text_of, word_of = text_word // feats.n, text_word % feats.n
        gram, first = feats.gram, np.searchsorted(feats.owner, np.arange(feats.n + 1))
        by_gram = np.zeros((2, GRAM_BUCKETS))
        for lo in range(0, len(toxic), 50):  # n-grams of so many texts at a time
            a, b = np.searchsorted(text_of, [lo, lo + 50])
            many = np.diff(first)[word_of[a:b]]
            spots = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[word_of[a:b]], many)
            by_gram += held(np.repeat(text_of[a:b], many), gram[spots], GRAM_BUCKETS)
        return cls(excess(*by_word), by_word[0], excess(*by_gram), by_gram[0])

    def clues(self, feats: Features) -> np.ndarray:
        """For each distinct word, the most that it or one of its n-grams tells."""
        out = self.word.copy()
        np.maximum.at(out, feats.owner, self.gram[feats.gram])
        return out

    def plant(self, net: Network, feats: Features) -> tuple[np.ndarray, np.ndarray]:
        """Start the first dimension of the embeddings at what is surely told; which rows may learn.

        What few texts hold stays at zero: a network would learn those texts by heart from it.
        """
        word = np.zeros(WORD_BUCKETS, bool)
        word[feats.word[self.word_texts >= LEAST_TEXTS]] = True
        gram = self.gram_texts >= LEAST_TEXTS
        net.p["word"][~word] = 0
        net.p["gram"][~gram] = 0
        np.maximum.at(net.p["word"][:, 0], feats.word, (np.clip(self.word - SURE, 0, 6) * 0.5).astype(_F))
        np.maximum(net.p["gram"][:, 0], (np.clip(self.gram - SURE, 0, 6) * 0.5).astype(_F), out=net.p["gram"][:, 0])
        return word, gram


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray], rows: dict[str, np.ndarray]) -> None:
        """``rows``: for embedding tables, the rows that the gradient is for."""
        self.t += 1
        fix = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, x in g.items():
            at = rows.get(k, slice(None))
            m = self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * x
            v = self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * x * x
            self.p[k][at] -= (fix * m / (np.sqrt(v) + 1e-7)).astype(_F)


def fit(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Train on whole texts with one label each."""
    net = Network.fresh(seed)
    y = np.array(toxic, dtype=float)
    if not len(texts) or not y.any():
        net.p["wo"][:] = 0
        net.p["bo"][:] = -3
        return net
    rng = np.random.default_rng(seed)
    words, feats = _corpus(texts)
    # by distinct word, in the order that each word's n-grams had; later steps take them as they are
    order = np.argsort(feats.owner, kind="stable")
    feats.owner, feats.gram = feats.owner[order], feats.gram[order]
    del order
    give_back()
    text, at, size = windows(words.counts, words.first)
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    evidence = _Evidence.of(words, feats, y)
    clue = evidence.clues(feats)[feats.index] if words.n else np.zeros(0)
    word_learns, gram_learns = evidence.plant(net, feats)
    strength = np.array([clue[a : a + n].max(initial=0) for a, n in zip(at, size)])
    adam = _Adam(net.p, RATE)
    gram, begin = feats.gram, np.searchsorted(feats.owner, np.arange(feats.n + 1))
    del clue, evidence
    give_back()
    for epoch in range(epochs):
        if epoch >= 3 and epoch % 2:
            strength = net.window_logits(feats, at, size).astype(float)
            give_back()
        by_strength = np.lexsort((-strength, text))
        chosen = by_strength[first[:-1]]
        clean = np.flatnonzero(y == 0)
        others = np.concatenate([rng.integers(first[clean], first[clean + 1]) for _ in range(2)]) if len(clean) else np.zeros(0, int)
        picked = np.concatenate([chosen, others])
        rng.shuffle(picked)
        adam.rate = RATE * (1 - epoch / epochs) + RATE * 0.1
        positive = max(1e-3, y[text[picked]].mean())
        for lo in range(0, len(picked), BATCH):
            w = picked[lo : lo + BATCH]
            index, mask = _grid(feats, at[w], size[w])
            rows, index = np.unique(index, return_inverse=True)
            index = index.reshape(mask.shape)
            real = rows < feats.n
            some = rows[real]
            many = begin[some + 1] - begin[some]
            spots = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[some], many)
            sub = Features.__new__(Features)
            sub.word, sub.owner, sub.gram, sub.weight = feats.word[some], np.repeat(np.arange(len(some)), many), gram[spots], feats.weight[some]
            keep = (rng.random(len(some)) > 0.3).astype(_F) * word_learns[sub.word]
            table = np.zeros((len(rows), DIM), _F)
            table[real] = net.embed(sub, keep)
            tape: dict = {}
            p = _sigmoid(net.forward(table, index, mask, tape))
            target = y[text[w]].astype(_F)
            weight = np.where(target > 0, 0.5 / positive, 0.5 / (1 - positive + 1e-3)).clip(0, 3)
            g, by_table = net.gradient(table, index, mask, tape, ((p - target) * weight / len(w)).astype(_F))
            by_row = by_table[real]
            word_rows, word_at = np.unique(sub.word, return_inverse=True)
            gram_rows, gram_at = np.unique(sub.gram, return_inverse=True)
            g["word"], g["gram"] = np.zeros((len(word_rows), DIM), _F), np.zeros((len(gram_rows), DIM), _F)
            np.add.at(g["word"], word_at, by_row * keep[:, None])
            np.add.at(g["gram"], gram_at, (by_row * sub.weight[:, None])[sub.owner])
            g["gram"] *= gram_learns[gram_rows][:, None]
            for name, rows_of in (("word", word_rows), ("gram", gram_rows)):
                g[name] += DECAY / max(1, len(w)) * net.p[name][rows_of]
            adam.step(g, {"word": word_rows, "gram": gram_rows})
    return net


def score_texts(net: Network, texts: pa.Array) -> np.ndarray:
    """The score of each text: the probability of its most toxic window."""
    out = np.empty(len(texts), dtype=np.float64)
    for lo, hi, words in word_chunks(texts, ALNUM, 1 << 20):
        feats = Features(words)
        text, at, size = windows(words.counts, words.first)
        logits = net.window_logits(feats, at, size).astype(np.float64)
        first = np.searchsorted(text, np.arange(hi - lo))
        out[lo:hi] = 1 / (1 + np.exp(-np.maximum.reduceat(logits, first)))
    return out


def taken(sizes: list[tuple[int, int, int, int]], most: int) -> list[int]:
    """Ids of the texts that are learnt from, out of (place, id, class, bytes) in order.

    A text that does not fit beside those taken of its class is passed over and counts for
    nothing; where no text of a class fits, its shortest is taken.
    """
    out: list[int] = []
    for label in {s[2] for s in sizes}:
        total, found = 0, []
        for _, doc_id, _, size in (s for s in sizes if s[2] == label):
            if total + size <= most:
                total += size
                found.append(doc_id)
        out += found or [min((s for s in sizes if s[2] == label), key=lambda s: s[3])[1]]
    return out


def train(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Fit on a bounded sample of the labelled rows that are not held out.

    The sample is taken in order of a hash of the id: so many texts of a class, each whole, and
    of them those that fit ``sample_bytes`` together with the ones before.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(crc_mod5(F.col("doc_id")) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    known = known.withColumn("place", F.xxhash64("doc_id"))
    chosen = [known.where(F.col("toxic") == y).orderBy("place", "doc_id").limit(n) for y, n in ((1, toxic), (0, clean))]
    texts = ids_and_texts(docs).where(F.length("text") > 0)
    # a few thousand ids at most, so the broadcast is bounded, and of their texts as many as fit
    rows = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "toxic", "place").agg(F.min("text").alias("text"))
    rows = checkpointed(rows)
    # ids and sizes of a few thousand texts at most
    sizes = sorted((r.place, r.doc_id, r.toxic, r.size) for r in rows.select("place", "doc_id", "toxic", F.octet_length("text").alias("size")).collect())
    fitting = docs.sparkSession.createDataFrame([(i,) for i in taken(sizes, sample_bytes)], "doc_id long")
    sample = rows.join(F.broadcast(fitting), "doc_id").select("doc_id", "text", "toxic")

    def learn(table: pa.Table) -> pa.Table:
        give_back()  # of what this worker did before
        found = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))))
        net = fit([t for _, t, _ in found], [int(y) for _, _, y in found])
        give_back()
        return pa.table([pa.array([zlib.compress(pickle.dumps(net.p), 1)], pa.binary())], names=["model"])

    # the sample is small and bounded: one task fits the network, and only its parameters come back
    model = sample.withColumn("all", F.lit("all")).groupBy("all").applyInArrow(learn, "model binary").first()
    return Network(pickle.loads(zlib.decompress(model.model))) if model else fit([], [])


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(shared.value, batch.column("text")))], ["doc_id", "score"])

    out = map_batches(ids_and_texts(docs), run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())]))
    return out.select("doc_id", (crc_mod5(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop(docs: DataFrame, net: Network) -> DataFrame:
    """The documents that are not predicted toxic, all their columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = boxed(docs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = pa.array(score_texts(shared.value, batch.column("row").field("text")) < 0.5)
        return batch.filter(kept)

    return map_batches(rows, run, rows.schema).select("row.*")
