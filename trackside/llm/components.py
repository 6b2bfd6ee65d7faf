"""Connected components over an edge table (alternating large-star / small-star).

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every
round is two grouped minima joined back on the edge table, so no node's
neighbours are ever gathered in one task, and the edge table is written to the
shared folder after each half round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackside.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node to the smallest of node and neighbours."""
    if large:  # all neighbours; only larger ones are re-linked
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # a is the larger end of each edge; its smaller neighbours and itself go to the minimum
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = (edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(low.select("a", F.col("m").alias("b"))))
    return (out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select("a", "b"))


def connected_components(pairs: DataFrame) -> DataFrame:
    """(a, b) pairs of longs -> (node, component): the smallest node reachable.

    Only nodes that occur in a pair of two different nodes appear. Stops when every
    edge leads from a node to its component's smallest; the number of rounds is
    about the square of the logarithm of the component size, at most.
    """
    edges = stored(pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), "cc-edges")
    while not _all_stars(edges):
        edges = stored(_star(edges, large=True), "cc-large")
        edges = stored(_star(edges, large=False), "cc-small")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _all_stars(edges: DataFrame) -> bool:
    """No node has two smaller neighbours, and no node is the smaller one of one edge and the larger of another."""
    forked = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
    chained = edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").select("a")
    return forked.unionByName(chained).isEmpty()
