"""Query op2: all documents mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyward.llm.mixing import mix, word_count
from tallyward.sources.staging import stage


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), "sizes")
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return mix(sizes, F.col("words")).select("doc_id", "size", "source_size", "target", taken, "copies")


QUERY = ("op2_source_mix", op2_source_mix)

# The level is found by stopping sources one after another in order of size per weight, as the operator does;
# ranks, starts and copies come from one window over each source.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source
), t AS (SELECT sum(source_size)::BIGINT AS words, sum(w)::BIGINT AS ws FROM s),
f AS (
  SELECT s.*, t.*,
    coalesce(sum(3 * source_size) OVER p, 0)::BIGINT AS stops, coalesce(sum(w) OVER p, 0)::BIGINT AS gone
  FROM s, t
  WINDOW p AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (SELECT *, (words - stops) / (ws - gone) * w > 3 * source_size AS stopped FROM f),
l AS (
  SELECT (any_value(words) - coalesce(sum(3 * source_size) FILTER (stopped), 0)::BIGINT)
       / (any_value(ws) - coalesce(sum(w) FILTER (stopped), 0)::BIGINT) AS level FROM c
), g AS (
  SELECT source, source_size, CASE WHEN stopped THEN CAST(3 * source_size AS DOUBLE) ELSE level * w END AS target,
         ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM c, l
), r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.u,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS e,
    row_number() OVER (PARTITION BY d.source ORDER BY
      length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)),
      ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2))::BIGINT, size,
      coalesce(CAST(doc_id AS VARCHAR), ''))::DOUBLE AS k
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), m AS (SELECT *, CAST(least(floor(e * k + u) - floor(e * (k - 1) + u), ceil(e)) AS INTEGER) AS copies FROM r)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM m
"""
