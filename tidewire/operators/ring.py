"""The last packets of a capture: a bounded ring as top-k over the packet number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(packets: DataFrame, capacity: int) -> DataFrame:
    return packets.orderBy(F.desc("number")).limit(capacity)


def snapshot(packets: DataFrame, capacity: int, n: int) -> DataFrame:
    """The newest n of the ring, newest first."""
    return packets.orderBy(F.desc("number")).limit(min(n, capacity))


def since(packets: DataFrame, capacity: int, cursor: int, n: int) -> DataFrame:
    """The newest n after the cursor, oldest first."""
    return packets.where(F.col("number") > cursor).orderBy(F.desc("number")).limit(min(n, capacity)).orderBy("number")


def find(packets: DataFrame, capacity: int, number: int) -> DataFrame:
    """One packet, if the ring still holds it (only the newest number is aggregated)."""
    newest = packets.agg(F.max("number").alias("_newest"))
    return packets.where(F.col("number") == number).crossJoin(F.broadcast(newest)).where(F.col("number") > F.col("_newest") - capacity).drop("_newest")


def state(packets: DataFrame, capacity: int) -> DataFrame:
    """size, pushed, dropped, oldest and newest of a ring that numbered packets were pushed into."""
    count = F.count(F.lit(1))
    return packets.agg(
        F.least(count, F.lit(capacity).cast("long")).alias("size"),
        count.alias("pushed"),
        F.greatest(count - capacity, F.lit(0).cast("long")).alias("dropped"),
        F.greatest(F.max("number") - (capacity - 1), F.min("number")).alias("oldest"),
        F.max("number").alias("newest"),
    )


def first_matched(packets: DataFrame, matched: Column, n: int) -> DataFrame:
    """Stop after n matches: the n matching packets with the smallest numbers."""
    return packets.where(matched).orderBy("number").limit(n)

