"""Query op4: secrets in every document, through a ledger of blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyward.llm.secret_ledger import Ledger, report, versions_of


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind and spans of every document; the ledger starts empty, so every distinct text is scanned once."""
    versions = versions_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ledger = Ledger.empty(spark)
    ledger.scan(versions)
    found = report(ledger.table("paths"), ledger.table("findings"))
    return found.select(
        F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans"
    )


QUERY = ("op4_secret_ledger", op4_secret_ledger)
