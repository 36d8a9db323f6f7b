"""Connected components of a graph in DataFrames, by contraction.

Each round, every node points to the least node among itself and its neighbours,
pointers are followed once more, and the edges are drawn between the new nodes.
Stars, however large, take one or two rounds. Hubs are only ever keys of partial
aggregations and of joins that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, component): the least node that it reaches. Nodes without an edge to another are not listed."""
    n = edges.count()
    live = written(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "edges", rows=n)
    labels, nodes = None, 2 * n
    while n := live.count():
        both = live.union(live.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("b"))
        parent = written(least.select(F.col("a").alias("node"), F.least("a", "b").alias("parent")), "parents", rows=2 * n)
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        hop = written(parent.join(up, "parent").select("node", F.col("grand").alias("component")), "hops", rows=2 * n)
        at_a = hop.select(F.col("node").alias("a"), F.col("component").alias("a2"))
        at_b = hop.select(F.col("node").alias("b"), F.col("component").alias("b2"))
        live = written(live.join(at_a, "a").join(at_b, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")).filter("a <> b").distinct(), "edges", rows=n)
        if labels is None:
            labels = hop
        else:
            after = hop.select(F.col("node").alias("component"), F.col("component").alias("new"))
            labels = written(labels.join(after, "component", "left").select("node", F.coalesce("new", "component").alias("component")), "labels", rows=nodes)
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
