"""Query op3: tokens of every line of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyward.llm.token_spans import section_counts


def op3_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``section``, ``start``, ``end`` and ``n_tokens`` of every line."""
    return section_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERY = ("op3_token_spans", op3_token_spans)
