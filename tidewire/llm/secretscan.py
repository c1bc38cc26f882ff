"""Secret scans: fixed patterns, and Markov models for strings that no pattern names.

Two character models of order two, one of random strings and one of ordinary words and
identifiers, score every long token without blanks; a token whose log-likelihood ratio is
high enough is a further span of kind ``random``; of a token that a base span touches, what
is left outside is judged.  Both models are trained from labelled samples: values that the patterns found in a bounded sample of documents and strings drawn
from a seeded generator are labelled random, other tokens of the same documents and
identifiers made of their words are labelled ordinary.  The sample is chosen by a hash of
the id, so it does not depend on how the table is split; everything is then scanned, whole.

Edge cases: a null text is empty and has no span; an empty sample leaves the models to the
generated strings; repeated rows are each reported; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import importlib
import random
import re
import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import boxed, ids_and_texts, map_batches

KINDS = ("assign", "access", "hex", "random")
#: The patterns of the base scan and the lengths below which a match is dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
_NAMED = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)

#: Tokens that the models judge.
CANDIDATE_LEAST = 12
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{CANDIDATE_LEAST},}}")
#: Documents in the training sample, at most about so many; the sample is taken by hash of the id.
SAMPLE_DOCS = 2000
#: Of each sampled document at most so many distinct words and secret values, and of all words so many stems
#: for generated identifiers; all are chosen by hash.
SAMPLE_WORDS, SAMPLE_VALUES, STEMS = 50, 50, 4000
#: Nats by which the random model must beat the ordinary one, and the least mean per character.
MARGIN, MARGIN_PER_CHAR = 12.0, 1.2

_SYMBOLS = string.ascii_letters + string.digits + "+/_=-"
_INDEX = np.full(128, len(_SYMBOLS), dtype=np.int64)
_INDEX[[ord(c) for c in _SYMBOLS]] = np.arange(len(_SYMBOLS))
_N = len(_SYMBOLS) + 1

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value_begin", T.LongType())])


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, begin, end, begin of the secret value) of the pattern matches, by kind."""
    out = []
    if (":" in text or "=" in text) and _NAMED.search(text):
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return out


def _codes(token: str) -> np.ndarray:
    return _INDEX[np.frombuffer(token.encode("ascii", "replace"), dtype=np.uint8) & 127]


@dataclass(frozen=True)
class MarkovPair:
    """Per-character log-likelihood ratios of two smoothed order-two models."""

    first: np.ndarray
    ratio: np.ndarray

    @classmethod
    def trained(cls, randoms: list[str], ordinaries: list[str], smooth: float = 0.3) -> MarkovPair:
        def model(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
            pair = np.zeros((_N, _N))
            triple = np.zeros((_N * _N, _N))
            for t in tokens:
                c = _codes(t)
                np.add.at(pair, (c[:-1], c[1:]), 1)
                np.add.at(triple, (c[:-2] * _N + c[1:-1], c[2:]), 1)
            single = pair.sum(0) + smooth
            single /= single.sum()
            two = (pair + 4 * single) / (pair.sum(1, keepdims=True) + 4)
            three = (triple.reshape(_N, _N, _N) + 6 * two[None]) / (triple.reshape(_N, _N, _N).sum(2, keepdims=True) + 6)
            return np.log(two), np.log(three)

        (r2, r3), (o2, o3) = model(randoms), model(ordinaries)
        return cls(r2 - o2, r3 - o3)

    def llr(self, token: str) -> float:
        c = _codes(token)
        if len(c) < 2:
            return 0.0
        return float(self.first[c[0], c[1]] + self.ratio[c[:-2], c[1:-1], c[2:]].sum())

    def is_random(self, token: str) -> bool:
        score = self.llr(token)
        return score >= MARGIN and score >= MARGIN_PER_CHAR * len(token)


def _generated_randoms(rng: random.Random, n: int) -> list[str]:
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "_-")
    return ["".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(20, 64))) for i in range(n)]


def _generated_identifiers(rng: random.Random, words: list[str], n: int) -> list[str]:
    """Words joined the ways that identifiers, paths and dates are written."""
    out = []
    for i in range(n):
        few = [rng.choice(words) for _ in range(rng.randint(2, 5))]
        kind = i % 7
        if kind < 4:
            out.append(("_", "-", "/", "")[kind].join(few))
        elif kind == 4:
            out.append("".join(w.capitalize() for w in few))
        elif kind == 5:
            out.append("_".join(few).upper())
        else:
            out.append(f"{rng.randint(1990, 2035)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}" + rng.choice(["", f"_{rng.randint(0, 9999)}", "=" * rng.randint(3, 30), "-" * rng.randint(3, 30)]))
    return [x for x in out if len(x) > 2]


def known_identifiers() -> list[str]:
    """Ordinary identifiers that are at hand everywhere: the public names of some standard modules."""
    found: set[str] = set()
    for name in ("builtins", "os", "socket", "ssl", "http", "email.message", "logging", "datetime", "threading", "subprocess", "unittest", "argparse", "decimal", "asyncio"):
        module = importlib.import_module(name)
        for public in (x for x in dir(module) if not x.startswith("_")):
            found.add(public)
            found.update(x for x in dir(getattr(module, public, None)) if not x.startswith("_"))
    return sorted(x for x in found if len(x) > 2)


def _some(values: list[str], n: int) -> list[str]:
    """At most n distinct values, chosen by hash and so from every place and letter alike."""
    return sorted(set(values), key=lambda v: (zlib.crc32(v.encode()), v))[:n]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> MarkovPair:
    """Fit both models on labelled strings of at most ``sample_docs`` documents.

    Documents are chosen by a hash of id and text, so rows that are alike count once and a null
    id is an id like any other.
    """
    rows = ids_and_texts(docs).where("text is not null").withColumn("key", F.xxhash64("doc_id", "text"))
    keys = rows.select("key").distinct()
    every = max(1, keys.count() // sample_docs)
    # so many numbers at most, hence broadcast
    chosen = keys.where(F.pmod("key", F.lit(every)) == 0).orderBy("key").limit(sample_docs)
    sample = rows.join(F.broadcast(chosen), "key").dropDuplicates(["key"]).select("doc_id", "text")

    def labelled(batch: pa.RecordBatch) -> pa.RecordBatch:
        strings, random_label = [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            values = [text[v:e] for _, _, e, v in spans]
            plain = text
            for value in values:
                plain = plain.replace(value, " ")
            words = _some(re.findall(r"[A-Za-z0-9+/_=-]{3,}", plain), SAMPLE_WORDS)
            values = _some(values, SAMPLE_VALUES)
            strings += [*values, *words]
            random_label += [True] * len(values) + [False] * len(words)
        return pa.RecordBatch.from_arrays([pa.array(strings, pa.string()), pa.array(random_label, pa.bool_())], ["token", "is_random"])

    strings = map_batches(sample, labelled, T.StructType([T.StructField("token", T.StringType()), T.StructField("is_random", T.BooleanType())]))
    # at most SAMPLE_WORDS + SAMPLE_VALUES strings from each of sample_docs documents; sorted, so the fit does not depend on task order
    found = sorted({(r.token, r.is_random) for r in strings.distinct().toLocalIterator()})
    return from_labelled([t for t, y in found if y and len(t) >= 12], [t for t, y in found if not y and not CANDIDATE.fullmatch(t)])


def from_labelled(randoms: list[str], words: list[str]) -> MarkovPair:
    rng = random.Random(20)
    plain = [w for w in words if w.isascii() and w.isalpha()]
    known = known_identifiers()
    stems = [*(w for w in known if w.isalpha()), *_some(plain, STEMS)]
    runs = [c * rng.randint(10, 60) for c in _SYMBOLS for _ in range(3)]
    ordinaries = [*words, *known, *runs, *_generated_identifiers(rng, stems, 8000)]
    return MarkovPair.trained([*[t for t in randoms if t.isascii()], *_generated_randoms(rng, 6000)], [w for w in ordinaries if w.isascii() and len(w) > 2])


def _judged(text: str, begin: int, end: int, models: MarkovPair) -> list[tuple[str, int, int, int]]:
    return [("random", begin, end, begin)] if end - begin >= CANDIDATE_LEAST and models.is_random(text[begin:end]) else []


def all_spans(text: str, models: MarkovPair) -> list[tuple[str, int, int, int]]:
    """Base spans and, outside them, the tokens that the models call random; by begin, then kind."""
    spans = base_spans(text)
    base = sorted((b, e) for _, b, e, _ in spans)
    k = 0
    reached = -1
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        # base spans are passed once, from left to right
        while k < len(base) and base[k][0] < end:
            b, e = base[k]
            if b > at and reached <= at:
                spans += _judged(text, at, b, models)
            at, reached, k = max(at, e), max(reached, e), k + 1
        at = max(at, min(reached, end))
        if at < end:
            spans += _judged(text, at, end, models)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _spans_of(texts: pa.Array, models: MarkovPair) -> list[list[dict]]:
    return [[dict(zip(("kind", "begin", "end", "value_begin"), s)) for s in all_spans(t or "", models)] for t in texts.to_pylist()]


_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("value_begin", pa.int64())]))


def scan(docs: DataFrame, models: MarkovPair | None = None) -> DataFrame:
    """doc_id and the spans of each row, in code points."""
    models = models or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_spans_of(batch.column("text"), shared.value), _ARROW_SPANS)], ["doc_id", "spans"])

    return map_batches(ids_and_texts(docs), run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))]))


def redact(docs: DataFrame, models: MarkovPair | None = None, mark: str = "[SECRET]") -> DataFrame:
    """All documents, with every secret value replaced in their text; other columns as they were."""
    models = models or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    rows = boxed(docs)
    schema = rows.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean = []
        row = batch.column("row")
        for text in row.field("text").to_pylist():
            spans = all_spans(text or "", shared.value)
            if spans:
                kept, at = [], 0
                for _, _, end, value in sorted(spans, key=lambda s: (s[3], s[2])):
                    if value >= at:
                        kept += [text[at:value], mark]
                    at = max(at, end)
                text = "".join([*kept, text[at:]])
            clean.append(text)
        fields = [f.name for f in row.type]
        columns = [pa.array(clean, pa.string()) if c == "text" else row.field(c) for c in fields]
        return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields)], ["row"])

    return map_batches(rows, run, schema).select("row.*")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, a hash of the base spans, and all spans as text."""

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def spans_text(spans: list[tuple[str, int, int, int]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e, _ in spans)


def sha256_of(spans: list[tuple[str, int, int, int]]) -> str:
    base = sorted((s for s in spans if s[0] != "random"), key=lambda s: (s[1], KINDS.index(s[0])))
    return hashlib.sha256(spans_text(base).encode()).hexdigest()
