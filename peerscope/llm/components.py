"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _done(edges: DataFrame) -> bool:
    """Whether every node points at one smaller node that points at none: counted in one pass over the links."""
    ends = edges.select("u", "v", F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("u"), F.col("v"), F.lit(0).alias("up")))
    node = ends.groupBy("u").agg(F.sum("up").alias("up"), F.min("up").alias("as_root"))
    return node.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("as_root") == 0))).isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for each id that has a link.

    Links are undirected; repeated ones and loops are fine. Each round points the larger neighbours of
    a node at its smallest neighbour, then the smaller ones; it ends when every node points at the
    smallest of its component, after a number of rounds that grows with the logarithm of a path's
    length. A node's minimum is combined before it is shuffled and joined back, so a node with very many
    links is no single task's work. Rounds are written to the shared folder.
    """
    edges = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while not _done(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "links")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
