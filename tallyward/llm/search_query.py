"""Query op6: nearest embeddings of every twentieth embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyward.llm.projected_search import nearest

QUERY_STEP = 20
NEAREST = 20


def op6_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the neighbours found."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, lambda vec_id: vec_id % QUERY_STEP == 0, NEAREST)


QUERY = ("op6_projected_neighbours", op6_projected_neighbours)
