"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("m_u")).agg(F.least(F.min("v"), F.col("m_u")).alias("m"))
    out = both.filter("v > u").join(least, F.col("u") == F.col("m_u"))
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. Here u > v."""
    least = edges.groupBy(F.col("u").alias("m_u")).agg(F.min("v").alias("m"))
    out = edges.join(least, F.col("u") == F.col("m_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(least.select(F.col("m_u").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def stars(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (u, v), in any direction and number: rows (u, v) of each node but the roots, v the
    smallest node of its component. Each round is a table of its own, so a lost executor costs
    a round at most; only counts come to the driver, and the links stay linear in the nodes."""
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), name)
    while True:  # labels fall each round, so it ends; rounds grow with the logarithm of the nodes
        n = now.agg(F.count(F.lit(1)), F.countDistinct("u")).first()
        if n[0] == n[1]:  # each node has one parent: stars, if no parent has one itself
            roots = now.select(F.col("v").alias("r")).distinct()
            if now.join(roots, F.col("u") == F.col("r"), "left_semi").isEmpty():
                return now
        now = stored(_small_star(stored(_large_star(now), name)), name)
