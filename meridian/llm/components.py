"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import drop, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Rounds of hooking and contraction: each node points to its smallest neighbour, pointers are doubled until
    they end at roots, edges between different roots go on to the next round. Every round at least halves the
    nodes that still have edges, so rounds grow with their logarithm. Every step is a join or a pre-aggregated
    minimum over tables in the shared scratch folder; Spark splits a root with many nodes (skew join). Null ends
    and loops are ignored, repeated edges do no harm, no edges give no rows.
    """
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct())
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        parents = materialize(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent")))
        while True:
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grandparent"))
            jumped = materialize(parents.join(up, "parent", "left").select("node", F.coalesce("grandparent", "parent").alias("parent"), (F.col("grandparent") != F.col("parent")).alias("moved")))
            moved = not jumped.filter("moved").isEmpty()
            drop(parents)
            parents = jumped.select("node", "parent")
            if not moved:
                break
        if labels is None:
            labels = parents.withColumnRenamed("parent", "component")
        else:
            step = parents.toDF("component", "root")
            labels = materialize(labels.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        of_a, of_b = parents.toDF("a", "root_a"), parents.toDF("b", "root_b")
        left = edges.join(of_a, "a").join(of_b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        left = materialize(left.filter("a <> b").distinct())
        drop(edges)
        edges = left
    return labels
