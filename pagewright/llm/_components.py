"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, discard


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(a long, b long) -> (node, component), the component's smallest node, for every node
    with an edge. Each round takes the smallest label among the neighbours and then the
    label of that label; all sums are pre-aggregated, labels are written and reread every
    round, and only the count of changed labels reaches the driver."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    table = labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("new"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("far"))
        step = step.join(jump, step.new == jump.at, "left").select("node", "old", F.least("new", F.coalesce("far", "new")).alias("component"))
        step = cut(step, "labels")
        done = step.where("old <> component").isEmpty()
        discard(table)
        table, labels = step, step.select("node", "component")
        if done:
            discard(both)
            labels.written = table.written
            return labels
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
