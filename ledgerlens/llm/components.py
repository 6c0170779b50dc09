"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Each round a node takes the least label of its neighbours and itself, then the label of
    that label (pointer jumping), so a chain of n nodes takes about log n rounds. Both
    joins and the minimum work on partial results; no component meets in one task. Every round
    is written, so a lost executor costs one round at most.
    """
    forward = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = written(forward.unionByName(forward.select(F.col("other").alias("node"), F.col("node").alias("other")))
                   .where("node <> other").distinct(), "edges")
    labels = written(both.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("component")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("component").alias("near"))
        least = both.join(seen, "other").groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(least, "node").select("node", F.col("component").alias("was"),
                                                 F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("root"), F.col("component").alias("above"))
        jumped = written(step.join(up, F.col("component") == F.col("root"), "left").select(
            "node", "was", F.least("component", F.coalesce("above", "component")).alias("component")), "labels")
        labels = jumped.select("node", "component")
        if jumped.where("component <> was").isEmpty():
            return labels
