"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.session import removed, tables_so_far, written

MOST_STEPS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the smallest of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them. Edges have u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(low, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", F.col("low").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` (the smallest id reachable) of every node with an edge to another one.

    Every step is two aggregations and joins on node ids; each result is written to the
    shared folder, so no step depends on an executor of an earlier one.  A hub with very many
    neighbours is aggregated before the shuffle, and its join can be split.
    """
    mark = tables_so_far()
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    for _ in range(MOST_STEPS):
        now = written(_small_star(_large_star(now).distinct()).distinct(), "edges")
        # the same edges as before: a fixed point, in which each component is a star
        size = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if size == before:
            removed(edges.sparkSession, mark, keep=[now])
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = size
    raise RuntimeError("the components did not settle")
