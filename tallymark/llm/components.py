"""Connected components of a graph given as a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import cut


def roots(links: DataFrame) -> DataFrame:
    """(node, root) of every node that `links` (u, v) names; root is the smallest node of the component. Nodes may be
    of any type with an order; links with a null or a loop are ignored. Each step is checkpointed; no link leaves the
    executors. The number of steps grows with the logarithm of the longest chain."""
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # a forest of stars: each node has one link, and what it leads to has none
        state = edges.groupBy("u").agg(F.count("*").alias("n"), F.max("v").alias("v"))
        bad = state.where("n > 1").limit(1).union(state.join(edges.select(F.col("u").alias("v")), "v", "left_semi").select("u", "n", "v").limit(1))
        if bad.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
        large = cut(both.where("v > u").join(cut(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        edges = cut(large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct())
