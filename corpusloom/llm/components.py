"""Connected components of a link table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import materialise


def _nearest(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the smaller of u and its smallest neighbour (m), in one shuffle."""
    return edges.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = _nearest(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    return low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))


def _stars(edges: DataFrame) -> bool:
    """Whether each node that has a link down has one, to a node that has none: then all links lead to their roots."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least")).where("down > 1 OR down > 0 AND least = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node reachable.

    Links to itself and repeated links are harmless. Rounds are few (the logarithm of the longest path
    in practice), none for links that already lead to their roots; each is written to the checkpoint folder, and the driver
    sees only whether one more is needed.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(edges):
        edges = materialise(_small_star(_large_star(edges)).where("u <> v").distinct())
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
