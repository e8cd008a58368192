"""Query op7: the language of every document by a byte convolutional network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyward.llm.byte_cnn import predict, train

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never trained on. A null id counts as the empty text, which is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, train(docs, ~held_out()), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERY = ("op7_byte_cnn", op7_byte_cnn)
