"""Connected components by alternating star contractions (large-star, small-star).

Each round links every node's larger neighbours, then its smaller ones, to the
least node of its neighbourhood; rounds grow with the logarithm of the longest
path. Nodes stay distributed: only a row count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))


def _unsettled(edges: DataFrame) -> DataFrame:
    """Nodes of ``edges`` (a > b) that have two parents, or a parent and a child; without any, each component is a star around its least node."""
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", F.lit(None).cast(edges.schema["b"].dataType)))
    seen = ends.groupBy("u").agg(F.min("v").alias("x"), F.max("v").alias("y"), F.count_if(F.col("v").isNull()).alias("children"))
    return seen.where("x <> y OR x IS NOT NULL AND children > 0")


def connected_components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """``(node, component)`` for each node of ``edges`` (columns a, b): the least node it can reach.

    Edges may repeat and point either way; a loop or a null end is ignored. No
    edges give no rows. The work grows with the edges; a star of any size costs
    one round.
    """
    edges = edges.select("a", "b").where("a <> b")
    k = 0
    while True:
        nxt = _small_star(_large_star(edges) if k else edges).where("a <> b").distinct()
        edges = stage.put(nxt, f"{name}-{k}")
        if k:
            stage.drop(f"{name}-{k - 1}")
        if not _unsettled(edges).count():
            break
        k += 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
