"""Connected components by alternating large-star and small-star steps, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, stored

#: Far above the logarithmic number of rounds that the method needs; reaching it is an error.
MOST_ROUNDS = 60


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame) -> DataFrame:
    """Links every neighbour above a node to the least of the node and its neighbours."""
    every = _both_ways(edges)
    least = every.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return every.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its neighbours below it to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for every node that isn't the least of its component: ``v`` is the least. ``edges``: u, v of any order, repeated or not.

    The edges of each round are written to the shared folder; a round that changes nothing ends it.
    """
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = _print_of(now)
    for _ in range(MOST_ROUNDS):
        if not seen[0]:
            return now
        after = stored(small_star(large_star(now)), "cc")
        found = _print_of(after)
        dropped(now)
        now = after
        if found == seen:
            return now
        seen = found
    raise RuntimeError("components did not settle")
