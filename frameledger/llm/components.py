"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, remove, store


def _smallest(arcs: DataFrame) -> DataFrame:
    """Per node the smallest of itself and its neighbours."""
    return arcs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    joined = arcs.join(_smallest(arcs), "u").where("v > u")
    return joined.select(F.col("least").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    arcs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = _smallest(arcs)
    moved = arcs.join(least, "u").select(F.col("least").alias("a"), F.col("v").alias("b"))
    return moved.union(least.select(F.col("least").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of comparable ids to (id, component), component being the smallest id reachable.

    Nodes without an edge don't appear. Every round is written to the shared folder, and rounds
    end when the stars no longer change; their number grows with the logarithm of the longest path.
    Self-loops and repeated edges are harmless; null ends are ignored.
    """
    spark = edges.sparkSession
    path = fresh_path(spark, "stars")
    current = store(edges.where("a <> b").select("a", "b").distinct(), path)
    seen = None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        following = fresh_path(spark, "stars")
        current = store(_small_star(_large_star(current)), following)
        remove(spark, path)
        path = following
    return current.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")).union(current.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
