"""Sharding by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards.  A key descends the tree: at each node every
child draws ``-ln(u) / weight`` with ``u`` hashed from the key and the child, and the least
draw wins.  A child's draw depends on that child alone, so when the weight of a subtree
changes, keys move only into it (if it grew) or out of it (if it shrank); elsewhere nothing
moves.  A shard that opens a subtree of its own therefore takes rows only into itself: from
``BASE`` shards on every further shard does.  Growing a tree below that, or giving a shard
another weight, moves rows into the whole subtree that gains weight.

Everything is Spark SQL expressions.  Id, size and checksum of every row are written once, so
that what is counted and what is numbered are the same rows whatever the input came from and
however often a task runs again; the shuffles carry these few integers per row, never a text.

Edge cases: a null ``doc_id`` is a key like any other; a null text has no bytes (size 16,
crc32 0); rows that repeat a ``doc_id`` share its shard and get slots of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.llm.common import checkpointed, place

LAW = "key"
#: Bytes that storing a row costs besides its text.
ROW_BYTES = 16
#: Numbering splits each shard into parts of about so many rows, 64 at least, so no task sorts a whole shard.
PART_ROWS, LEAST_PARTS = 50_000, 64
#: Shards that are arranged in full regions; each one beyond them opens a region of its own.
BASE = 40


@dataclass(frozen=True)
class ShardTree:
    """Weighted leaves under racks under regions; children of a node are (node, weight)."""

    regions: tuple[tuple[int, float], ...]
    racks: tuple[tuple[tuple[int, float], ...], ...]
    shards: tuple[tuple[tuple[int, float], ...], ...]

    @classmethod
    def of(cls, n_shards: int, racks: int = 4, per_rack: int = 5, weights: dict[int, float] | None = None, base: int = BASE) -> ShardTree:
        """The first ``base`` shards in order of rack and region; each further one is a region of its own."""
        if n_shards < 1:
            raise ValueError("a tree needs at least one shard")
        weight = {i: float((weights or {}).get(i, 1.0)) for i in range(n_shards)}
        if min(weight.values()) <= 0:
            raise ValueError("weights must be positive")
        full = min(n_shards, base)
        shards = [[(i, weight[i]) for i in range(r, min(full, r + per_rack))] for r in range(0, full, per_rack)]
        regions = [list(range(g, min(len(shards), g + racks))) for g in range(0, len(shards), racks)]
        for i in range(full, n_shards):
            regions.append([len(shards)])
            shards.append([(i, weight[i])])
        rack_weight = [sum(w for _, w in rack) for rack in shards]
        groups = [[(r, rack_weight[r]) for r in region] for region in regions]
        tops = [(g, sum(w for _, w in group)) for g, group in enumerate(groups)]
        return cls(tuple(tops), tuple(map(tuple, groups)), tuple(map(tuple, shards)))


def _children(nodes) -> Column:
    return F.array(*[F.struct(F.lit(int(n)).alias("node"), F.lit(float(w)).alias("weight")) for n, w in nodes])


def _descend(key: Column, level: str, children: Column) -> Column:
    """The child with the least weighted draw; equal draws go to the smaller node."""

    def draw(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), child["node"]), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.ln(u) / child["weight"]).alias("draw"), child["node"].alias("node"))

    return F.array_min(F.transform(children, draw))["node"]


def assign(key: Column, tree: ShardTree) -> Column:
    """The shard of a key: three weighted draws, one for each level."""
    region = _descend(key, "region", _children(tree.regions))
    rack = _descend(key, "rack", F.get(F.array(*[_children(x) for x in tree.racks]), region))
    return _descend(key, "shard", F.get(F.array(*[_children(x) for x in tree.shards]), rack))


def shard(docs: DataFrame, n_shards: int = 40, tree: ShardTree | None = None, grown: ShardTree | None = None) -> DataFrame:
    """Place every row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` numbers the rows of a shard from 0 without gaps, part by part and in a part by ``doc_id``.
    """
    tree = tree or ShardTree.of(n_shards)
    grown = grown or ShardTree.of(n_shards + 1)
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")))
    parts = max(LEAST_PARTS, -(-rows.count() // (PART_ROWS * n_shards)))
    placed = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        assign(F.col("doc_id"), tree).alias("shard"),
        assign(F.col("doc_id"), grown).alias("grown_shard"),
        # also deals out rows that are alike in all columns
        F.pmod(place(), F.lit(parts)).alias("part"),
    )
    spread = placed.repartition("shard", "part")
    # one row for each shard and part
    counted = spread.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    ranked = spread.withColumn("nth", F.row_number().over(within))
    return ranked.join(offsets, ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("base") + F.col("nth") - 1).cast("long").alias("slot"),
        "grown_shard",
    )
