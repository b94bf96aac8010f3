"""Components and closures of edge tables, by iterated joins that end in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.storage import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of (a, b); component is its smallest node.

    Each round takes the smallest label around a node, then that label's own label.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        met = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        heads = labels.select(F.col("node").alias("component"), F.col("component").alias("head"))
        new = written(met.join(heads, "component").select("node", "old", F.least("component", "head").alias("component")))
        labels = new.select("node", "component")
        if not new.where(F.col("old") != F.col("component")).limit(1).count():
            return labels


def closure(start: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node) of everything that edges reach from start, itself included. Only new rows are joined again."""
    seen = written(start.select("node").distinct())
    fresh = seen
    while True:
        near = fresh.join(edges.select(F.col(source).alias("node"), F.col(target).alias("next")), "node").select(F.col("next").alias("node")).distinct()
        fresh = written(near.join(seen, "node", "left_anti"))
        if not fresh.limit(1).count():
            return seen
        seen = written(seen.unionByName(fresh))


def reachable(edges: DataFrame) -> DataFrame:
    """(a, b): whatever edges (a, b) reach, in one step or more. Each round joins only the pairs that are new."""
    edges = written(edges.select("a", "b").distinct())
    seen = fresh = edges
    while True:
        near = fresh.join(edges.select(F.col("a").alias("b"), F.col("b").alias("next")), "b").select("a", F.col("next").alias("b")).distinct()
        fresh = written(near.join(seen, ["a", "b"], "left_anti"))
        if not fresh.limit(1).count():
            return seen
        seen = written(seen.unionByName(fresh))
