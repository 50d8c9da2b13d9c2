"""Connected components by large-star and small-star steps, all of them joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nudgetrail.llm.common import Stages


def components(edges: DataFrame, stages: Stages, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); the smallest node names it.

    Each step links neighbours to the smallest of them, so that the number of steps grows with the
    logarithm of the longest path. Smallest neighbours are combined before the shuffle and written,
    so that a node with any share of all edges is joined in parts. Loops and repeats do no harm.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, turn = stages.cut(ordered.where("a > b").distinct(), f"{name}-0"), 0
    while True:
        turn += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = stages.cut(least.select("a", F.least("a", "m").alias("m")), f"{name}-{turn}-l")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m"))
        large = stages.cut(large.withColumnRenamed("m", "b"), f"{name}-{turn}-large")
        least = stages.cut(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-{turn}-s")
        rest = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), "m")
        small = rest.unionByName(least).withColumnRenamed("m", "b").distinct()
        now = stages.cut(small, f"{name}-{turn}")
        # Done when every node has one parent and no parent has another.
        if now.count() == least.count():
            roots = now.select(F.col("b").alias("a"))
            if now.join(roots, "a", "left_semi").isEmpty():
                roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
                return now.toDF("node", "component").unionByName(roots.distinct())
