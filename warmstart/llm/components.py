"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a partial aggregation (the smallest neighbour of every node) and a join; links never
leave the executors; only counts reach the driver, to see whether the links are stars already.
Every round is stored, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warmstart.llm.common import store


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # every larger neighbour of u points to the least of u's neighbourhood
    return (both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return (moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct())


def _settled(e: DataFrame) -> bool:
    """True if the links (u, v), v < u, are stars: every u has one v and no v is a u."""
    heads = e.select(F.col("u").alias("v")).distinct()
    r = e.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("d")).first()
    return r["n"] == r["d"] and e.join(heads, "v", "left_semi").isEmpty()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node that it reaches.

    ``links``: (u, v) of a comparable type; loops and repeated links are fine, a link with a null end connects
    nothing, an empty table gives an empty table. The rounds needed grow with the logarithm of the longest path; if they pass
    ``max_rounds`` the call raises instead of returning an unfinished result."""
    e = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = store(e, "links")
    for _ in range(max_rounds):
        if _settled(e):
            tips = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return tips.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        e = store(_small_star(_large_star(e)), "links")
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
