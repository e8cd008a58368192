"""Query op12: hard negatives of every fiftieth embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyward.llm.hard_negatives import hard_negatives

ANCHOR_STEP = 50
MOVED_STEP = 7
LABELS = 10


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % MOVED_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return hard_negatives(rows, lambda vec_id: vec_id % ANCHOR_STEP == 0, label)


QUERY = ("op12_hard_negatives", op12_hard_negatives)

ORACLE_SQL = r"""
WITH good AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.id AS anchor, b.id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM good a JOIN good b ON a.id <> b.id WHERE a.id % 50 = 0
),
positive AS (
  SELECT anchor, other AS positive, score AS ps FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5
),
ranked AS (
  SELECT anchor, positive, ps, other, score, row_number() OVER (PARTITION BY anchor, positive ORDER BY score DESC, other) AS place
  FROM positive JOIN scored USING (anchor) WHERE NOT same AND 50 * ps <= 100 * score AND 100 * score <= 95 * ps
)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(place AS INTEGER) AS rank, other AS negative_id, ps AS positive_score, score AS negative_score
FROM ranked WHERE place <= 3
"""
