"""Query op9: pages written as WARC archives with revisits, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyward.llm.warc import register
from tallyward.sources.staging import fresh_path, stage

LEAST_REVISIT_BYTES = 0
UNDATED = "1970-01-01T00:00:00Z"


def revisit_roles(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """``page_id``, ``sha1``, ``first`` (the page that holds the payload) of each distinct page id and payload.

    Of equal payloads of at least ``least_bytes`` the page with the largest id is the response; a null id is one only if
    its payload has no other. Only ids and digests are shuffled, and the largest id of a digest is found by partial maxima.
    """
    ids = stage(pages.select("page_id", "sha1", F.octet_length("payload").alias("bytes")).distinct(), "page-ids")
    first = ids.groupBy("sha1").agg(F.max("page_id").alias("first"))
    held = F.when(F.col("bytes") >= least_bytes, F.col("first")).otherwise(F.col("page_id"))
    return ids.join(first, "sha1").select("page_id", "sha1", held.alias("first"))


def write_pages(pages: DataFrame, path: str) -> None:
    """Archive ``page_id``, ``url`` and ``html`` (null as empty); repeated rows give a record each."""
    register(pages.sparkSession)
    whole = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", whole.alias("payload")).withColumn("sha1", F.sha1("payload"))
    roles = revisit_roles(rows).withColumnsRenamed({"page_id": "_page", "sha1": "_sha1"}).hint("shuffle_hash")
    # Ids are hashed, payloads stream past them unsorted.
    joined = rows.join(roles, rows["page_id"].eqNullSafe(roles["_page"]) & (rows["sha1"] == roles["_sha1"]))
    same = F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    records = joined.select(
        F.when(same, "response").otherwise("revisit").alias("warc_type"),
        urn("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(UNDATED).alias("warc_date"),
        F.col("sha1").alias("payload_sha1"),
        F.octet_length("payload").alias("payload_bytes"),
        F.when(~same, urn("first")).alias("refers_to"),
        F.when(same, F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode("append").save(path)


def op9_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` as read from the archives.

    Responses are read with their payloads and verified; revisits by their headers alone.
    """
    path = fresh_path(spark, "warc")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    source = spark.read.format("warc").option("path", path)
    full = source.option("verify", "true").load().filter("warc_type = 'response'")
    brief = spark.read.format("warc").option("path", path).option("payload", "false").load().filter("warc_type = 'revisit'")
    columns = ["record_id", "payload_bytes", "payload_digest", "warc_type", "refers_to"]
    found = full.select(*columns).union(brief.select(*columns))
    number = lambda c: F.regexp_extract(c, "([0-9-]*)>$", 1).try_cast("long")
    return found.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        number("refers_to").alias("refers_to"),
    )


QUERY = ("op9_warc_pages", op9_warc_pages)

ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT body, max(page_id) AS first FROM p GROUP BY body)
SELECT page_id, CAST(strlen(p.body) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, CAST(1 + 5 * (k // 4) AS BIGINT), 5))::INTEGER >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1, 1) FOR k IN range(32)], '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f ON f.body = p.body
"""
