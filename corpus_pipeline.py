"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Each stage takes ``(spark, docs, sf_dir)``. Rows that repeat an id are told apart by 128 bits of their text; columns that the
stages do not know are carried along. Null texts and texts without a letter go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyward.llm.byte_cnn import UNKNOWN, Network, has_letter, predict, train
from tallyward.llm.decontaminate import leaks
from tallyward.llm.language_query import held_out
from tallyward.llm.marks import text_mark
from tallyward.llm.mixing import emit, mix, word_count
from tallyward.llm.near_query import fingerprint_groups
from tallyward.llm.secret_ledger import Ledger, redacted, versions_of
from tallyward.sources.staging import stage

RARE = 0.001


def least_score(docs: DataFrame, net: Network) -> float:
    """The mean probability that a document must reach: half way from chance to what all but ``RARE`` of the labelled
    held-out documents reach. The network has not seen these; without any, every probability is enough."""
    known = docs.filter(held_out() & F.col("lang").isNotNull() & has_letter(F.col("text")))
    low = predict(known, net, [], names=("_lang_pred", "_score")).agg(F.percentile_approx("_score", RARE, 10000)).first()[0]
    chance = 1 / len(net.languages)
    return 0.0 if low is None else chance + (low - chance) / 2


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages: those without a letter go, and those for whose best language the mean probability
    is below ``least_score``. Where no training row has a language there is no network, and all texts with a letter stay."""
    net = train(docs, ~held_out())
    if net is None:
        return docs.filter(has_letter(F.col("text")))
    judged = predict(docs, net, docs.columns, names=("_lang_pred", "_score"))
    return judged.filter((F.col("_lang_pred") != UNKNOWN) & (F.col("_score") >= least_score(docs, net))).select(docs.columns)


def _key(doc_id: Column) -> Column:
    """The id as text; a null id is the empty text, which no other id is."""
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit(""))


def _keyed(docs: DataFrame) -> DataFrame:
    """``_key`` and ``_mark``, neither null: rows that agree in both have the same id and text."""
    return docs.withColumns({"_key": _key(F.col("doc_id")), "_mark": text_mark(F.col("text"))})


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of SimHash links, with the shingles and the distance of op5; a row
    without id only if no other has one."""
    first = F.min(F.struct(F.col("doc").isNull(), F.col("doc"), F.col("mark"))).alias("first")
    chosen = fingerprint_groups(docs).groupBy("root").agg(first)
    chosen = stage(chosen.select(_key(F.col("first.doc")).alias("_key"), F.col("first.mark").alias("_mark")).distinct(), "chosen")
    found = _keyed(docs).join(chosen.hint("shuffle_hash"), ["_key", "_mark"], "left_semi")
    # Rows that agree in id and text are still together: one stays.
    same = Window.partitionBy("_key", "_mark").orderBy(F.lit(0))
    return found.withColumn("_n", F.row_number().over(same)).filter("_n = 1").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = leaks(docs, items).select(_key(F.col("doc_id")).alias("_key"), F.col("mark").alias("_mark"))
    return _keyed(docs).join(stage(found.distinct(), "leaks"), ["_key", "_mark"], "left_anti").select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind in square brackets; ``n_chars`` follows the new text."""
    ledger = Ledger.empty(spark)
    ledger.scan(versions_of(docs))
    clean = redacted(docs, ledger.table("findings"))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Systematic mix of the sources; one row for each copy taken, numbered in ``copy``."""
    return emit(mix(docs, word_count(F.col("text"))))


STAGES = [
    ("language", with_language),
    ("near duplicates", without_near_copies),
    ("benchmark", without_benchmark),
    ("secrets", without_secrets),
    ("mix", mixed),
]

# No SQL: it cannot express the classifier. tests/llm compares the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
