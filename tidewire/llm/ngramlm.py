"""Language-model scores from a weighted backoff automaton over word n-grams.

The model.  States are the histories of up to ``ORDER - 1`` tokens seen in training (texts
begin with a start token) and the root, which has read nothing.  From a state with count c,
an n-gram seen k times is an arc of weight ``(k + mu * below) / (c + mu)`` that leads to the
longest suffix that is a state; every other token follows the failure arc of weight
``mu / (c + mu)`` to the next shorter history, where ``below`` is the weight found there.  At
the root a token weighs ``(c + 0.5) / (N + 0.5 (V + 1))``.  So the weights of every state sum
to one.  ``mu = ONCE / c**3 + MU * c**POWER``: a history seen once says little about what
follows it, one seen twice already does.  A text is read once from left to right; the state
is carried along and log10 weights add up.

The job.  No task ever holds the whole model.  Documents are gathered into blocks of about
``BLOCK_BYTES`` as they lie in the table and written compressed.  A block lists its distinct
n-grams with their training counts and sends each slice of the sorted list to the shard of
that hash range.  A shard adds up the counts of equal n-grams over all blocks and answers
each block in the order it was asked.  With the answers a block builds exactly the part of
the automaton that its texts can touch (:class:`Automaton`) and reads its texts in it.
Blocks and shards grow in number, not in size; nothing is pruned, capped or broadcast but
two totals, and texts enter one shuffle, compressed.

n-grams are known by 56 bits of a hash.  Edge cases: a null or empty text is its end token
alone; without training rows every token is unknown and N is 0; repeated rows are learnt
from and scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import checkpointed, crc_mod5
from tidewire.llm.textbatch import SPACED, mix, word_chunks

ORDER = 3
ONCE, MU, POWER = 120.0, 20.0, 0.6
#: Tokens of a text that are read in one go; a longer text is read in parts, each from the state the one before ends in.
LANE = 128
BLOCK_BYTES = 4 << 20
#: n-grams that one shard adds up.  A block sends each shard one message, so messages shrink as
#: shards grow in number; they are never more than the n-grams of the blocks.
SHARD_ENTRIES = 2_000_000
#: From so many hashes in a message on, their sixth bytes are counted instead of written.
_MANY = 1024
_U = np.uint64
_START, _END = _U(0x53544152_54000001), _U(0x454E4400_00000001)


class Grams:
    """Tokens of some texts (start, words, end) and the n-gram that ends at each."""

    def __init__(self, texts: pa.Array) -> None:
        tokens, lengths = [], []
        for lo, hi, words in word_chunks(texts, SPACED):
            at = words.first[1:] + np.arange(hi - lo) * 2 + 1
            out = np.full(words.n + 2 * (hi - lo), _END, dtype=np.uint64)
            starts = words.first[:-1] + np.arange(hi - lo) * 2
            out[starts] = _START
            is_word = np.ones(len(out), dtype=bool)
            is_word[starts] = is_word[at] = False
            out[is_word] = words.hashes()
            tokens.append(out)
            lengths.append(words.counts + 2)
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        self.lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.lengths)

    def ending(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, 56-bit hashes) of the k-grams; the start is in a history but no token of its own."""
        at = np.flatnonzero(self.place >= max(1, k - 1))
        h = np.zeros(len(at), dtype=np.uint64)
        for j in range(k - 1, -1, -1):
            h = mix(h + self.tokens[at - j] * _U(2 * j + 3))
        return at, mix(h + _U(k)) >> _U(8)


def _thin(values: np.ndarray) -> bytes:
    """Counts in one byte each; those of 255 and more follow in eight."""
    small = np.minimum(values, 255).astype(np.uint8)
    return small.tobytes() + values[values >= 255].astype("<u8").tobytes()


def _thick(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, dtype=np.uint8, count=n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, dtype="<u8", offset=n)
    return out


def _counter(n: int) -> np.dtype:
    return np.dtype("<u2" if n < 1 << 16 else "<u4")


def _hash_bytes(hashes: np.ndarray) -> bytes:
    """The low six bytes of sorted 56-bit hashes, the top one being told by the shard; of many, five after a count for each value of the sixth."""
    low = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)
    if len(hashes) < _MANY:
        return np.ascontiguousarray(low[:, :6]).tobytes()
    many = np.bincount(low[:, 5], minlength=256).astype(_counter(len(hashes)))
    return many.tobytes() + np.ascontiguousarray(low[:, :5]).tobytes()


def _hashes(data: bytes, n: int, top: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    if n < _MANY:
        out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    else:
        kind = _counter(n)
        out[:, :5] = np.frombuffer(data, dtype=np.uint8, offset=256 * kind.itemsize).reshape(-1, 5)
        out[:, 5] = np.repeat(np.arange(256, dtype=np.uint8), np.frombuffer(data, dtype=kind, count=256))
    out[:, 6] = top
    return out.view("<u8").ravel()


_ASK = T.StructType([T.StructField("shard", T.LongType()), T.StructField("block", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("hashes", T.BinaryType()), T.StructField("counts", T.BinaryType())])
_ANSWER = T.StructType([T.StructField("block", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("counts", T.BinaryType()), T.StructField("types", T.LongType()), T.StructField("tokens", T.LongType())])
_SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def _table(schema: T.StructType, rows: list[tuple]) -> pa.Table:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BinaryType(): pa.binary(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64()}
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(c, kinds[f.dataType]) for c, f in zip(columns, schema)], names=[f.name for f in schema])


def ask(block: int, texts: pa.Array, trained: np.ndarray, orders: tuple[int, ...], shards: int) -> list[tuple]:
    """What a block asks of each shard: its distinct n-grams and their counts in training texts."""
    grams = Grams(texts)
    rows = []
    learns = np.repeat(trained, grams.lengths)
    for k in orders:
        at, hashes = grams.ending(k)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        counts = np.bincount(inverse, weights=learns[at], minlength=len(distinct)).astype(np.int64)
        edges = np.searchsorted(distinct, np.arange(shards + 1, dtype=np.uint64) * _U((1 << 56) // shards)) if shards > 1 else np.array([0, len(distinct)])
        edges[-1] = len(distinct)
        rows += [(s, block, k, b - a, _hash_bytes(distinct[a:b]), _thin(counts[a:b])) for s, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if a < b]
    return rows


def answer(shard: int, asked: list[tuple], shards: int) -> list[tuple]:
    """Total counts of every n-gram asked of a shard, for each block in its own order."""
    rows = []
    for k in sorted({r[0] for r in asked}):
        mine = sorted((r for r in asked if r[0] == k), key=lambda r: r[1])
        hashes = np.concatenate([_hashes(h, n, shard * 256 // shards) for _, _, n, h, _ in mine])
        counts = np.concatenate([_thick(c, n) for _, _, n, _, c in mine])
        distinct, inverse = np.unique(hashes, return_inverse=True)
        totals = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
        spread, lo = totals[inverse], 0
        for i, (_, block, n, _, _) in enumerate(mine):
            first = i == 0 and k == 1
            rows.append((block, shard, k, n, _thin(spread[lo : lo + n]), int((totals > 0).sum()) if first else 0, int(totals.sum()) if first else 0))
            lo += n
    return rows


@dataclass
class Automaton:
    """The states and arcs that some texts can touch, as arrays.

    State 0 is the root.  Arcs are found by state and token; a state without an arc for a
    token is left by its failure arc.
    """

    fails: np.ndarray
    """By state, the state of the next shorter history."""
    fail_log: np.ndarray
    """By state, log10 of the weight of the failure arc."""
    keys: np.ndarray
    """Sorted keys of the arcs: state times the number of tokens, plus the token."""
    arc_log: np.ndarray
    arc_to: np.ndarray
    root_log: np.ndarray
    """By token, log10 of the weight at the root."""
    root_to: np.ndarray
    start: int

    @classmethod
    def built(cls, grams: Grams, ids: list[np.ndarray], counts: list[np.ndarray], order: int, root: np.ndarray, start_token: int, begins: float) -> Automaton:
        """``ids[k]`` has at each position the number of the (k + 1)-gram ending there, -1 if none; ``counts[k]`` are by number."""
        tokens = len(counts[0])
        seen = [c.astype(np.float64) for c in counts]
        seen[0][start_token] = begins
        # the number of the first state of each length; a history never seen in training is no state
        state_of: list[np.ndarray] = []
        total = 1
        for c in seen[: order - 1]:
            known = c > 0
            numbers = np.cumsum(known) - 1 + total
            state_of.append(np.where(known, numbers, -1))
            total += int(known.sum())
        fails, mass = np.zeros(total, np.int64), np.zeros(total)
        weights = [root]
        suffix = [np.zeros(tokens, np.int64)]
        keys, logs, to = [], [], []
        for k in range(1, order + 1):
            at = np.flatnonzero(ids[k - 1] >= 0)
            one = np.empty(len(counts[k - 1]), np.int64)
            one[ids[k - 1][at]] = at  # some position of each gram
            if k > 1:
                inner = ids[k - 2][one]  # the gram without its first token
                suffix.append(inner)
                history = ids[k - 2][one - 1]
                c, n = seen[k - 2][history], seen[k - 1]
                mu = ONCE / np.maximum(c, 1) ** 3 + MU * np.maximum(c, 1) ** POWER
                below = weights[k - 2][inner]
                weights.append(np.where(c > 0, (n + mu * below) / (c + mu), below))
                real = np.flatnonzero(n > 0)
                keys.append(state_of[k - 2][history[real]] * tokens + ids[0][one[real]])
                logs.append(np.log10(weights[k - 1][real]))
                to.append(_longest(k if k < order else k - 1, real if k < order else inner[real], state_of, suffix))
            if k < order:
                real = np.flatnonzero(state_of[k - 1] >= 0)
                own = state_of[k - 1][real]
                c = seen[k - 1][real]
                mu = ONCE / c**3 + MU * c**POWER
                mass[own] = np.log10(mu / (c + mu))
                fails[own] = _longest(k - 1, suffix[k - 1][real], state_of, suffix) if k > 1 else 0
        joined = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.int64), (logs, np.float64), (to, np.int64))]
        by_key = np.argsort(joined[0])
        start = state_of[0][start_token] if order > 1 else 0
        return cls(fails, mass, *(x[by_key] for x in joined), np.log10(root), _longest(1, np.arange(tokens), state_of, suffix), max(0, int(start)))

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log10 weight) of one token for each of some readers."""
        state = state.copy()
        weight = np.zeros(len(state))
        after = np.empty(len(state), np.int64)
        going = np.arange(len(state))
        while len(going):
            at_root = state[going] == 0
            done = going[at_root]
            weight[done] += self.root_log[token[done]]
            after[done] = self.root_to[token[done]]
            going = going[~at_root]
            if not len(going):
                break
            key = state[going] * len(self.root_log) + token[going]
            spot = np.searchsorted(self.keys, key)
            spot[spot == len(self.keys)] = 0
            found = self.keys[spot] == key if len(self.keys) else np.zeros(len(key), bool)
            done = going[found]
            weight[done] += self.arc_log[spot[found]]
            after[done] = self.arc_to[spot[found]]
            going = going[~found]
            weight[going] += self.fail_log[state[going]]
            state[going] = self.fails[state[going]]
        return after, weight

    def read(self, token: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: int) -> np.ndarray:
        """log10 weights of all tokens of texts; each text begins with its start token, whose weight is zero.

        All texts are read at the same time, token after token.  A text longer than a lane
        goes in several: the state after ``order - 1`` tokens does not depend on what was
        before them, so a lane reads that many again to find the state it carries on from.
        """
        out = np.zeros(len(token))
        body = np.maximum(lengths - 1, 0)
        many = np.maximum(1, -(-body // LANE))
        text = np.repeat(np.arange(len(starts)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        first = starts[text] + 1 + nth * LANE
        last = np.minimum(first + LANE, (starts + lengths)[text])
        warm = np.where(nth > 0, order - 1, 0)
        state = np.where(nth > 0, 0, self.start)
        place = first - warm
        by_length = np.argsort(place - last, kind="stable")
        first, last, place, state = first[by_length], last[by_length], place[by_length], state[by_length]
        going = len(first)
        while going:
            going = int(np.count_nonzero(place[:going] < last[:going]))
            if not going:
                break
            now = place[:going]
            state[:going], weight = self.step(state[:going], token[now])
            scored = now >= first[:going]
            out[now[scored]] = weight[scored]
            place[:going] += 1
        return out


def _longest(k: int, grams: np.ndarray, state_of: list[np.ndarray], suffix: list[np.ndarray]) -> np.ndarray:
    """The state of the longest suffix of each k-gram that is one; the root if none is."""
    out = np.zeros(len(grams), np.int64)
    if k < 1 or k > len(state_of):
        return out
    state = state_of[k - 1][grams]
    out[state >= 0] = state[state >= 0]
    rest = np.flatnonzero(state < 0)
    if k > 1 and len(rest):
        out[rest] = _longest(k - 1, suffix[k - 1][grams[rest]], state_of, suffix)
    return out


def weigh(grams: Grams, answers: dict[int, np.ndarray], order: int, n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions of tokens, their training counts, log10 weights found by the traversal)."""
    at, _ = grams.ending(1)
    ids, counts = [], []
    for k in range(1, order + 1):
        where, hashes = grams.ending(k)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        if len(distinct) != len(answers[k]):
            raise ValueError("a block got answers that are not for its n-grams")
        number = np.full(len(grams.tokens), -1, np.int32)
        number[where] = inverse
        count = answers[k]
        if k == 1:
            # the start is a history, but no token of its own
            number[grams.starts] = len(distinct)
            count = np.append(count, 0)
        ids.append(number)
        counts.append(count)
    known = counts[0][ids[0][at]]
    ends = counts[0][ids[0][grams.starts + grams.lengths - 1]]
    root = (counts[0] + 0.5) / (n + 0.5 * (v + 1))
    # texts that begin: as many as ends were seen
    machine = Automaton.built(grams, ids, counts, order, root, len(counts[0]) - 1, float(ends.max(initial=0)))
    return at, known, machine.read(ids[0], grams.starts, grams.lengths, order)[at]


_BLOCK = T.StructType([T.StructField("block", T.LongType()), T.StructField("texts", T.BinaryType())])


def _packed(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(block, texts): the rows of a task, about ``block_bytes`` of text at a time, as compressed Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal number, size
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for batch in held:
                    out.write_batch(batch)
            number, size = number + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "texts"])

        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                before = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + block_bytes - size, side="right")))
                held.append(batch.slice(lo, hi - lo))
                size += int(ends[min(hi, len(ends)) - 1]) - before
                lo = hi
                if size >= block_bytes or lo < batch.num_rows:
                    yield block()
        if held:
            yield block()

    return rows.mapInArrow(run, _BLOCK)


def _texts(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def score(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # the top byte of a hash is told by its shard, so there are 256 at least; about five bytes make a token
    shards = 256 << max(0, math.ceil(math.log2(max(1, size * order / 5 / shard_entries / 256))))
    blocks = checkpointed(_packed(rows.select("doc_id", (crc_mod5(F.col("doc_id")) == 1).alias("held_out"), "text"), block_bytes))

    def asking(orders: tuple[int, ...]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, data in zip(*(batch.column(c).to_pylist() for c in ("block", "texts"))):
                    table = _texts(data)
                    trained = ~table.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                    yield from _table(_ASK, ask(block, table.column("text"), trained, orders, shards)).to_batches()

        return blocks.mapInArrow(run, _ASK)

    def answering(key: tuple, table: pa.Table) -> pa.Table:
        return _table(_ANSWER, answer(key[0].as_py(), list(zip(*(table.column(c).to_pylist() for c in ("k", "block", "n", "hashes", "counts")))), shards))

    # long n-grams are the most, so each order from the third on has a shuffle of its own, and its files go before the next
    turns = [tuple(range(1, min(2, order) + 1)), *((k,) for k in range(3, order + 1))]
    answers = reduce(DataFrame.unionByName, [checkpointed(asking(orders).groupBy("shard").applyInArrow(answering, _ANSWER)) for orders in turns])
    v, n = answers.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()

    def scoring(key: tuple, packed: pa.Table, answered: pa.Table) -> pa.Table:
        if not packed.num_rows:
            return _table(_SCORED, [])
        table = _texts(packed.column("texts")[0].as_py())
        got = sorted(zip(*(answered.column(c).to_pylist() for c in ("k", "shard", "n", "counts"))))
        by_order = {k: np.concatenate([_thick(c, m) for o, _, m, c in got if o == k] or [np.zeros(0, np.int64)]) for k in range(1, order + 1)}
        grams = Grams(table.column("text"))
        at, known, logs = weigh(grams, by_order, order, n, v)
        first = np.cumsum(grams.lengths - 1) - (grams.lengths - 1)
        base = np.log10((known + 0.5) / (n + 0.5 * (v + 1)))
        m = table.num_rows
        return pa.table(
            [table.column("doc_id"), table.column("held_out"), pa.array(grams.lengths - 1), pa.array(np.add.reduceat((known > 0).astype(np.int64), first)), pa.array(np.full(m, n, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(logs, first))],
            names=[f.name for f in _SCORED],
        )

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scoring, _SCORED)
