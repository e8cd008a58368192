"""Query op5: near-duplicate groups of all documents by SimHash links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyward.llm.bk_shards import RADIUS, links
from tallyward.llm.components import components
from tallyward.llm.simhash import SHINGLE, fingerprints
from tallyward.sources.staging import stage


def fingerprint_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Groups of SimHash links.

    ``doc``, ``mark``, ``fp``, ``root`` (the group) and ``component`` (its smallest id, itself included) of every row.

    Null and empty texts have fingerprint 0 and are linked like any other. Null ids get a component but name none.
    Copies meet in their fingerprint before any search, so a fingerprint takes part once however many rows have it.
    """
    prints = stage(fingerprints(docs, doc_id, text, k), "prints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc").alias("doc")), "distinct")
    rooted = components(links(distinct.select("fp"), radius))
    named = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = stage(named, "named")
    least = named.groupBy("root").agg(F.min("doc").alias("component"))
    return prints.join(named.join(least, "root").select("fp", "root", "component"), "fp")


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every document."""
    found = fingerprint_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("doc").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


QUERY = ("op5_simhash_groups", op5_simhash_groups)
