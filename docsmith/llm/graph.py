"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _mins(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    mins = _mins(both).select("u", F.least("u", "m").alias("m"))
    return both.join(mins, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node joins its smaller neighbours, and itself, to the least of them; here v < u in every edge."""
    mins = _mins(edges)
    handed = edges.join(mins, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionByName(mins.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node of a table of links (u, v).

    Both star steps keep the components and end in a star around each least node, after
    a number of rounds that grows with the logarithm of the longest path.  A hub's
    neighbours meet in joins that can be split, and in minima that are taken partly before the
    shuffle; no group is gathered in a task.  Each round is written to the shared
    folder, so a lost executor costs a round at most.
    """
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or state == seen:
            break
        seen = state
        after = materialise(_small_star(_large_star(now)), "links")
        discard(now)
        now = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
