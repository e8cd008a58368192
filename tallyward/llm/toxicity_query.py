"""Query op13: the toxicity of every document by a learned weighted lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyward.llm.toxic_lexicon import learn, scores

FOLDS = 4
HELD_OUT = 2
TOXIC_FROM = 0.3


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from. A null id counts as the empty text; it has no label."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def op13_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = scores(docs, learn(docs, labels, ~held_out()), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


QUERY = ("op13_toxic_lexicon", op13_toxic_lexicon)
