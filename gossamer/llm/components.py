"""Connected components of a distributed edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, sized


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", n: int | None = None) -> DataFrame:
    """(node, root) of every node of an edge; root is the smallest node of its component. n: how many edges there are, if known.

    Each step hooks neighbours to the least neighbour by a grouped minimum and a join, so no node's neighbours are ever
    gathered; the table is written after each round, which ends when a round changes nothing.
    """
    now = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges", n)
    n = now.count()
    while True:
        before, m = now, n
        both = before.select("u", "v").union(before.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that a node of very many edges meets its least neighbour by broadcast, or in parts that Spark splits
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least", 2 * m)
        large = both.where("v > u").join(sized(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(small, "u")
        now = durable(hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges", 2 * m)
        n = now.count()
        same = n == m and now.exceptAll(before).isEmpty()
        discard(before)
        discard(least)
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
