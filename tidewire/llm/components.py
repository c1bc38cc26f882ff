"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, for every id that an edge (a, b) names.

    Each round takes the least label among neighbours and then the label of that label, so
    labels travel twice as far every round.  Rounds are checkpointed; nothing is collected
    but the number of labels that changed.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        heads = labels.select(F.col("id").alias("next"), F.col("component").alias("beyond"))
        moved = hooked.join(heads, "next", "left").select("id", F.col("component").alias("was"), F.least("next", F.coalesce("beyond", "next")).alias("component"))
        moved = checkpointed(moved)
        changed = moved.where("was != component").limit(1).count()
        labels = moved.select("id", "component")
        if not changed:
            return labels
