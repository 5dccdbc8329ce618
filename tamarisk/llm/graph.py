"""Connected components of a graph given as pairs of numbers, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    links = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return links.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(node, component): every node of a pair with the least node of its component.

    edges(a, b): numbers; loops, nulls and repeats do no harm.  A star, however large, takes one round; each round is
    written to the shared folder, and a node's pairs are joined (never gathered), so a hub is split like any skewed key.
    """
    now = materialise(edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), what)
    while True:
        # A star forest: every node has one smaller neighbour, which has none itself.
        broken = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(1).alias("x")).limit(1)
        chained = now.select(F.col("b").alias("a")).distinct().join(now.select("a"), "a", "left_semi").select(F.lit(1).alias("x")).limit(1)
        if broken.unionByName(chained).isEmpty():
            break
        now = materialise(_small_star(_large_star(now)), what)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
