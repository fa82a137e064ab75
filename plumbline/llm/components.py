"""Connected components of an edge table by alternating large-star and small-star rounds.

A round is two aggregations to a minimum and two joins; no node's neighbours are ever gathered in one place, and every round is
written to the shared folder, so that lost executors cost one round at most. Rounds end when nothing moves any more, which is
so after a number of them that grows with the square of the logarithm of the nodes at most.

Defined cases: loops and repeated edges count for nothing; no edges give no rows; ties don't occur, as nodes are distinct numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    up = both.filter("b > a").join(least, "a")
    return up.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(moved).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b: bigint) that isn't its component's smallest; empty for no edges."""
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        after = materialise(_small_star(_large_star(now)), "edges")
        discard(now)
        now = after
