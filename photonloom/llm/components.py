"""Connected components of a table of links, by alternating stars: every step is an aggregation and a join, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links(a, b); component is the least node that can be reached.

    Large stars move a node's greater neighbours to its least neighbour, small
    stars its lesser ones, until nothing changes; the number of rounds grows
    with the logarithm of the longest path. Links of a node with itself and
    repeated links do no harm; without links there are no rows.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", compact=True)
    mark = _mark(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, edges = edges, staged(small, "stars", compact=True)
        unstage(old)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError("the components have not settled")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s"), F.sum(F.xxhash64("v", "u") % 998_244_353).alias("t")).first()
    return tuple(row)
