"""Connected components of an undirected graph by smallest labels and shortcuts, each round a staged table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b); component is the smallest node reachable.

    A round gives every node the smallest label among its neighbours', then the label of that label, so a path of n
    nodes takes about log n rounds. No part of the graph reaches the driver but the count of changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage(both, "edges")
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
    last = stage(first.select("node", F.least("node", "b").alias("component")), "labels")
    while True:
        labels = last.select("node", "component")
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        nearer = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        # the label's own label; a node's label is a node
        via = nearer.select(F.col("node").alias("__node"), F.col("component").alias("via"))
        jumped = nearer.join(via, nearer["component"] == via["__node"]).select("node", F.least("component", "via").alias("component"), (F.least("component", "via") != F.col("old")).alias("changed"))
        before, last = last, stage(jumped, "labels")
        discard(before)
        if last.where("changed").isEmpty():
            discard(both)
            return last.select("node", "component")
