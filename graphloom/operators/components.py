"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 50) -> DataFrame:
    """(node, component): the component is the least node of it; nodes are those with an edge.

    Each round hands the least label of the neighbours on and then jumps to the label's label, so long
    chains take a logarithmic number of rounds. Labels are aggregated by node with partial aggregation; no neighbour list is built.
    Edges with a null end are left out; an empty table gives no rows.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", "component", F.least("component", "m").alias("next"))
        jump = step.select(F.col("node").alias("k"), F.col("next").alias("j"))
        new = step.join(jump, F.col("next") == F.col("k"), "left").select("node", "component", F.least(F.coalesce("j", "next"), "next").alias("new"))
        new = cut(new)
        changed = new.where("new <> component").limit(1).count()
        labels = new.select("node", F.col("new").alias("component"))
        if not changed:
            return labels
    raise RuntimeError("the components did not settle")
