"""Query op1: byte strings that occur twice, removed from every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyward.llm.suffix_buckets import remove_repeats


def op1_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of every document."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERY = ("op1_suffix_buckets", op1_suffix_buckets)
