"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyward.sources.staging import fresh_path, remove, stage_at


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is hung on the node's smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.filter("v > u").join(least, "u")
    return joined.select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of them. Here ``a > b`` in every edge."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.withColumnRenamed("m", "b").union(moved).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) of every node of ``edges`` (``a``, ``b``, longs) but roots.

    Alternates the two steps until a round changes nothing; each round is written to the shared folder, so neither
    lineage nor files pile up. A node's group is only ever reduced to its minimum, never gathered; the joins on nodes
    of very many edges have one row a node on the other side and can be split by adaptive execution.
    """
    spark = edges.sparkSession
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    at = fresh_path(spark, "edges")
    now = stage_at(ordered, at)
    mark = _mark(now)
    while True:
        middle, after = fresh_path(spark, "edges"), fresh_path(spark, "edges")
        then = stage_at(_small_star(stage_at(_large_star(now), middle)), after)
        remove(spark, at, middle)
        found = _mark(then)
        if found == mark:
            return then.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now, at, mark = then, after, found
