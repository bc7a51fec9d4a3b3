"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattika.operators.rounds import drop


def connected_components(edges: DataFrame, source: str, target: str, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """node, component: the smallest node that each node of `edges` reaches.

    Each round takes the least label among the neighbours, then jumps to the label of the label, so a chain of n
    nodes takes about log n rounds; any type that has an order will do for nodes. `keep(df, label)` writes a round's table where all executors read it.
    Edges with a null end and loops count for nothing.
    """
    plain = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a <> b")
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # one pass: a union of both ways plans and computes the edges twice
    both = keep(plain.select(F.inline(ways)).distinct(), "edges")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component"), F.lit(True).alias("fell")), "labels")
    while not labels.where("fell").isEmpty():
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        least = labels.join(near, labels.node == near.a).select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        root = least.select(F.col("node").alias("component"), F.col("component").alias("root"))
        now = F.least("component", "root")
        before, labels = labels, keep(least.join(root, "component", "left").select("node", now.alias("component"), (now < F.col("old")).alias("fell")), "labels")
        drop(before)
    drop(both)
    return labels.select("node", "component")
