"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _linked_to_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> the same with the least neighbour of u, or u itself, as m.

    The minima are a table of their own, so that the join's sides are plain exchanges
    and Spark can split a node that very many edges share.
    """
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "star-minima")
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _linked_to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    linked = _linked_to_least(down)
    return linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long), in either direction -> node, root: the least node that it reaches. Nodes without edges are absent."""
    now = stored(edges.where("u <> v").distinct(), "star-edges")
    before = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen["n"] == 0 or seen == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = seen
        wide = stored(_large_star(now).distinct(), "star-large")
        now = stored(_small_star(wide).distinct(), "star-small")
