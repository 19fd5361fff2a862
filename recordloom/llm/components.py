"""Connected components of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` lead from a larger node to a smaller one."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node points to one other, which points nowhere."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("is_end")).union(
        edges.select(F.col("b").alias("node"), F.lit(0), F.lit(1))
    )
    of_node = ends.groupBy("node").agg(F.sum("points").alias("points"), F.max("is_end").alias("is_end"))
    return of_node.where("points > 1 OR points = 1 AND is_end = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node it is linked to) for the nodes of links (a, b).

    The smallest node of a component has no row of its own.

    Each round lets every node point to the smallest of its neighbours, until every node points
    to one that points nowhere: the smallest of its component. Only aggregations and joins by
    node; minima are taken before the shuffle, so a node with many links is no hot key. Rounds
    grow with the logarithm of the longest chain, and each is written to the shared folder.
    Links of a node to itself and NULL ends are ignored; no links give no rows.
    """
    edges = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = stored(edges.distinct())
    while not _are_stars(edges):
        edges = stored(_small_star(_large_star(edges)))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
