"""Connected components of an edge table, by hooking to the least neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written



def components(edges: DataFrame, number: int | None = None) -> DataFrame:
    """(node, root) for every node of the edges (a, b), about ``number``: root is the least node it is linked with.

    Each round every node takes its least neighbour as parent, pointers jump until all stand on nodes
    without a smaller neighbour, and edges are relabelled to these; at least half of the nodes go in
    each round, and jumps double the way.  Minima are pre-aggregated, and joins read written tables on both
    sides, so a node with very many edges is split.
    Nodes of any orderable type; no edges give no rows.
    """
    edges, labels = written(edges.filter("a <> b").select("a", "b").distinct(), number), None
    number = 2 * edges.count()
    before, kept = edges, None
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), number)
        while True:
            further = written(_relabel(parent, parent), number)
            discard(parent)
            parent = further
            if further.filter("moved").isEmpty():
                break
        own, parent = parent, parent.select("node", "root")
        if labels is None:
            labels, kept = parent, own
        else:
            old, kept = kept, written(_relabel(labels, parent).select("node", "root"), number)
            labels = kept
        for end in ("a", "b"):
            edges = edges.join(parent, edges[end] == parent["node"], "left").withColumn(end, F.coalesce("root", end)).select("a", "b")
        edges = written(edges.filter("a <> b").distinct(), number)
        discard(before, *([own, old] if own is not kept else []))
        before = edges
    discard(before)
    labels.written_to = kept.written_to
    return labels


def _relabel(labels: DataFrame, parent: DataFrame) -> DataFrame:
    up = parent.select(F.col("node").alias("at"), F.col("root").alias("up"))
    return labels.join(up, F.col("root") == F.col("at"), "left").select("node", F.coalesce("up", "root").alias("root"), (F.coalesce("up", "root") != F.col("root")).alias("moved"))
