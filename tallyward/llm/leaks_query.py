"""Query op10: benchmark items that documents leak."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyward.llm.decontaminate import leaks


def op10_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``item_id``, ``start``, ``n_words`` and ``similarity`` of the best window of each leak."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, items).select("doc_id", "item_id", "start", "n_words", "similarity")


QUERY = ("op10_simhash_windows", op10_simhash_windows)

# All windows of a pair that shares any shingle are compared, of shorter documents the whole; items are taken to have five words or more, as all given ones.
ORACLE_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
ish AS (
  SELECT item_id, len(w) AS n_words, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT item_id, w, UNNEST(range(1, len(w) - 3)) AS i FROM iw WHERE len(w) >= 5)
),
ic AS (SELECT item_id, n_words, s, count(*) AS d FROM ish GROUP BY ALL),
dsh AS (
  SELECT doc_id, i - 1 AS at, len(w) AS size, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5)
),
hits AS (SELECT dsh.doc_id, dsh.at, dsh.size, ic.item_id, ic.n_words, ic.s, ic.d FROM dsh JOIN ic ON ic.s = dsh.s),
pairs AS (
  SELECT DISTINCT doc_id, size, item_id, n_words, least(size, n_words) AS w_words FROM hits WHERE least(size, n_words) - 4 >= 0.8 * (n_words - 4)
),
windows AS (SELECT doc_id, item_id, n_words, w_words, UNNEST(range(0, size - w_words + 1)) AS start FROM pairs),
counts AS (
  SELECT w.doc_id, w.item_id, w.n_words, w.w_words, w.start, h.s, any_value(h.d) AS d, count(*) AS c
  FROM windows w JOIN hits h ON h.doc_id = w.doc_id AND h.item_id = w.item_id AND h.at BETWEEN w.start AND w.start + w.w_words - 5 GROUP BY ALL
),
same AS (SELECT doc_id, item_id, n_words, w_words, start, CAST(sum(least(c, d)) AS BIGINT) AS same FROM counts GROUP BY ALL),
scored AS (SELECT *, same / (n_words - 4 + w_words - 4 - same) AS similarity FROM same),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS k FROM scored WHERE similarity >= 0.8)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, CAST(w_words AS INTEGER) AS n_words, similarity FROM ranked WHERE k = 1
"""
