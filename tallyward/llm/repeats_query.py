"""Query op8: word runs that a smaller document has, removed from every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyward.llm.block_anchors import remove_repeats


def op8_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` of every document."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERY = ("op8_block_anchors", op8_block_anchors)

ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (
  SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS run FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
),
least AS (SELECT run, min(doc_id) AS first FROM runs GROUP BY run HAVING count(DISTINCT doc_id) > 1),
gone AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM runs JOIN least USING (run), (SELECT UNNEST(range(0, 50)) AS k) WHERE first < doc_id
),
words AS (SELECT doc_id, UNNEST(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
marked AS (SELECT words.*, gone.pos IS NOT NULL AS away FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.pos = words.pos),
counted AS (
  SELECT doc_id, count(*) FILTER (away) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT away) AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN counted ON counted.doc_id = d.doc_id
"""
