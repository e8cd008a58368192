"""Connected components of edge tables by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyward.sources.staging import fresh_path, remove, stage_at


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) of every node of ``edges`` (``a``, ``b`` of one orderable type).

    A round hangs the larger neighbours of each node, then the node and its smaller neighbours, on the smallest of them; the
    rounds grow with the logarithm of the longest path. Each is written to the shared folder and the one before removed.
    """
    spark, at = edges.sparkSession, fresh_path(edges.sparkSession, "edges")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now, known = stage_at(edges.select(high.alias("a"), low.alias("b")).distinct(), at), None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        hung = both.filter("v > u").join(both.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
        down = hung.filter("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        path = fresh_path(spark, "edges")
        then = stage_at(least.withColumnRenamed("m", "b").union(moved).distinct(), path)
        remove(spark, at)
        # Stars: every node has one edge, and no root has one.
        counts = tuple(then.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        now, at = then, path
        if counts == known:
            return _with_roots(now)
        known = counts


def _with_roots(stars: DataFrame) -> DataFrame:
    leaves = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
