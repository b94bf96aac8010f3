"""Connected components of an edge table by smallest labels and pointer jumping, or in one task where there are few edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.arrays import trimmed
from loomgraph.llm.session import discard, written


#: So many edges are joined in one task, in a few dozen bytes each; more take rounds of joins.
ONE_TASK = 300_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of edges that one task reads."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}
        types = None

        def root(x):
            top = x
            while above[top] != top:
                top = above[top]
            while above[x] != top:
                above[x], x = top, above[x]
            return top

        for batch in batches:
            types = batch.schema.field("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                above.setdefault(a, a), above.setdefault(b, b)
                a, b = root(a), root(b)
                if a != b:
                    above[max(a, b)] = min(a, b)
        nodes = list(above)
        for i in range(0, len(nodes), 1 << 16):
            part = nodes[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, types), pa.array([root(x) for x in part], types)], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(trimmed(run), f"node {kind}, component {kind}")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of (a, b); component is its smallest node.

    A round takes the smallest label around each node and then that label's label, so
    a chain of n nodes needs about log n rounds. Each round ends in a written table.
    """
    edges = written(edges.select("a", "b"), "cc-given")
    if edges.count() <= ONE_TASK:
        labels = written(_in_one_task(edges), "cc-labels")
        discard(edges)
        return labels
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    discard(edges)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")), "cc-labels")
    labels_table = labels
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        met = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        heads = labels.select(F.col("node").alias("component"), F.col("component").alias("head"))
        new = written(met.join(heads, "component").select("node", "old", F.least("component", "head").alias("component")), "cc-labels")
        done = not new.where(F.col("old") != F.col("component")).limit(1).count()
        discard(labels_table)
        labels, labels_table = new.select("node", "component"), new
        if done:
            discard(both)
            labels.written_path = new.written_path
            return labels
