"""Connected components of an edge table by alternating stars (Kiveris et al. 2014), all in DataFrame operations.

Every round halves distances to the smallest node of a component. Edges are written to the shared folder after each
round, so lineage stays short and nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varsift.llm import common


def _least(pairs: DataFrame) -> DataFrame:
    """For each u the smallest of itself and its neighbours."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).union(edges)
    joined = both.join(_least(both), "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it can reach) for every node of an edge that isn't its own root.

    edges has the columns u and v; loops, repeated edges and either direction are allowed.
    """

    def written(df: DataFrame, share: int, *done: DataFrame) -> DataFrame:
        return common.stored(df.where("u <> v").distinct().coalesce(common.parts(df.sparkSession, share)), "edges", *done)

    # what the edges come from may be much work; from then on they are short rows, for which a few files do
    edges = written(edges.select("u", "v"), 4)
    before = None
    while True:
        edges = written(_small_star(_large_star(edges).where("u <> v").distinct()), 64, edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
