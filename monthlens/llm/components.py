"""Connected components by alternating large-star and small-star steps, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthlens.llm.common import stored

#: Edges up to which the smallest neighbours of their nodes (two longs each) are broadcast.
BROADCAST_EDGES = 500_000


def edges_of(labels: DataFrame) -> DataFrame:
    """(a, b): edges that join what labels (node, label) have in one class."""
    return labels.select(F.col("node").alias("a"), F.col("label").alias("b"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for the nodes of edges (a, b) of longs, stored; label: the smallest node reachable.

    Each round links every neighbour to the smallest node near it; the rounds (about the
    logarithm of the longest path) end when every node is linked to its label alone, which edges
    that are so from the start show without a round.  Every round is written to the shared
    folder, so a lost executor costs one round at most.  While there are ``BROADCAST_EDGES``
    edges at most, edges are shuffled once a round, and none gathers at a node that many share;
    beyond, Spark joins by shuffle.  Empty edges give an empty table; loops and repeated edges
    are harmless.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = stored(e)
    for _ in range(most_rounds):
        few = e.count() <= BROADCAST_EDGES
        near = F.broadcast if few else (lambda x: x)
        # the smallest of each node's neighbourhood, itself included
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        of_u = near(low.withColumnRenamed("m", "mu"))
        of_v = near(low.select(F.col("u").alias("v"), F.col("m").alias("mv")))
        seen = e.join(of_u, "u").join(of_v, "v")
        if seen.filter("mu <> v or mv <> v").isEmpty():
            break
        # large star: neighbours above a node go to the smallest of the node's neighbourhood
        e = (seen if few else stored(seen)).select("u", F.col("mv").alias("v"))
        # small star: a node and its lower neighbours go to the smallest of them
        least = near(e.groupBy("u").agg(F.min("v").alias("m")))
        e = (e.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
             .select("x.u", "x.v").filter("u <> v").distinct())
        e = stored(e)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return low.select(F.col("u").alias("node"), F.col("m").alias("label"))
