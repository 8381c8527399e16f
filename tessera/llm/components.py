"""Connected components by alternating star contractions, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, stored


def _settled(edges: DataFrame) -> bool:
    """Whether every node is tied to one node alone, and that to none."""
    tied = edges.groupBy("u").agg(F.count("*").alias("n"))
    open_ends = edges.select(F.col("v").alias("u")).distinct().join(tied, "u", "left_semi").select("u")
    return tied.filter("n > 1").select("u").unionByName(open_ends).isEmpty()


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """links(a, b) -> node, root for every node with a link; root is the least node that it reaches.

    Large star: the larger neighbours of u are tied to the least neighbour; small star: the others are. Each is a
    minimum per node, which is combined before the shuffle, and a join back; no neighbourhood is ever collected."""
    u, v = F.greatest("a", "b"), F.least("a", "b")
    edges = stored(links.filter("a <> b").select(u.alias("u"), v.alias("v")).distinct(), folder, f"{name}-0", True)
    step = 0
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        new = stored(small, folder, f"{name}-{step}", True)
        forget(links.sparkSession, f"{folder}/{name}-{step - 1}")
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
