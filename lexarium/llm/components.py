"""Connected components by alternating large and small stars, on Spark only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import join_split, settle


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def star_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to stars: (a, b) for every node b but the smallest of its component, which is a.

    Direction, repeats and loops of the input don't matter. Minimums are taken by groupBy with partial aggregation, and go back to
    the edges of nodes that have very many by broadcast, so these are no hot keys. Each round is written to the checkpoint folder;
    the number of rounds grows with the logarithm of the number of nodes.
    """
    edges = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    was = _sum(edges)
    while was[0]:
        # large star: each node's larger neighbours go to the smallest it knows
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = settle(join_split(both, least, "u", 2 * was[0]).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct())
        # small star: each node's smaller neighbours go to the smallest of them
        small = large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = join_split(large, small, "b", was[0])
        edges = settle(
            joined.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").union(small.select(F.col("m").alias("a"), "b")).distinct()
        )
        now = _sum(edges)
        if now == was:
            break
        was = now
    return edges
