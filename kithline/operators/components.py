"""Connected components of an undirected graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.scratch import materialise_counted


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Each round links the larger neighbours of a node to its smallest neighbour, then the
    smaller ones.  The number of rounds grows with the logarithm of the graph's width.
    Only a count and a checksum of the links come to the driver.  A node with very many
    links is a hot key of a join between links and per-node minima; minima are combined
    before the shuffle and the adaptive planner splits the links.
    """
    def written(found: DataFrame) -> tuple[DataFrame, tuple]:
        out, state = materialise_counted(found, "links", n=F.count(F.lit(1)), sum=F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
        return out, (state["n"], state["sum"])

    links, state = written(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    while state != before and state[0]:
        before = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        # Now every link goes from a larger node v to a smaller one u.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(joined.select(F.col("m").alias("u"), "v"))
        links, state = written(small.filter("u <> v").distinct())
    members = links.groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("node"), "component")
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
