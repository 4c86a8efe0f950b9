"""Connected components of a link table by alternating large-star and small-star rounds.

Kiveris et al., Connected Components in MapReduce and Beyond (2014).  A round is an
aggregation and a join on nodes; no node's neighbours are gathered in one place, so a hub
only makes a join key frequent, which adaptive execution splits.  Each round is written to
the shared folder, so that lost executors repeat one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.union(edges.select("b", "a")).toDF("x", "y")
        least = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
        return both.join(least, "x").where("y > x and y <> m").select(F.col("y").alias("a"), F.col("m").alias("b")).distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component): the smallest node reachable from each node of the links (a, b); others are not listed.

    Links to itself, repeated links and links with a null end add nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    edges = B.stored(edges, name)
    seen = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state[0] == 0 or state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        seen = state
        edges = B.stored(_star(_star(edges, True), False), name)
