"""Query op11: spelling variants among the words of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyward.llm.spelling import misspelt, variants, vocabulary


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word."""
    return variants(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet"), misspelt))


QUERY = ("op11_spelling_variants", op11_spelling_variants)

ORACLE_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
),
runs AS (
  SELECT doc_id, translate(UNNEST(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hexed AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes FROM counted),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    [4294967295] || list_transform(range(length(bytes) // 2), lambda i: CAST('0x' || substr(bytes, 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS h
  FROM hexed, crc
),
spelt AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed
),
vocab AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, UNNEST(range(length(word))) AS i FROM vocab)
),
shorter AS (SELECT DISTINCT g.word AS a, g.n AS an, v.word AS b, v.n AS bn FROM gaps g JOIN vocab v ON v.word = g.rest),
near AS (
  SELECT g.word AS a, g.n AS an, o.word AS b, o.n AS bn FROM gaps g JOIN gaps o ON g.rest = o.rest AND g.i = o.i AND g.word <> o.word
  UNION ALL SELECT * FROM shorter UNION ALL SELECT b, bn, a, an FROM shorter
),
best AS (SELECT a, count(*) AS n_near, min({'n': -bn, 'word': b}) AS top FROM near GROUP BY a),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.n >= 2 * n THEN top.word END AS form, CASE WHEN -top.n >= 2 * n THEN -top.n END AS form_n
  FROM vocab LEFT JOIN best ON a = word
),
chain AS (
  SELECT word, form AS at FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.at WHERE formed.form IS NOT NULL
),
ends AS (SELECT chain.word, chain.at AS root FROM chain JOIN formed ON formed.word = chain.at WHERE formed.form IS NULL)
SELECT formed.word, form, coalesce(root, formed.word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends ON ends.word = formed.word
"""
