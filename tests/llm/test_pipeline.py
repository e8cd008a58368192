"""The pipeline's stages one by one, and its rows as a whole, against brute force."""

import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from tallyward.llm.secret_ledger import BASE_RULES, scan_text
from tests.llm.conftest import as_frame, prose

GIVEN = "/root/testdata/sf0.001"


def test_stages_are_named():
    assert [n for n, _ in pipeline.STAGES] == ["language", "near duplicates", "benchmark", "secrets", "mix"]


def test_language_rejects_texts_without_letters(spark, sf_dir, documents):
    docs = as_frame(spark, documents)
    kept = pipeline.with_language(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    want = Counter((r[0], r[1]) for r in documents if r[1] and any(c.isalpha() for c in r[1]))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want


def test_one_of_each_near_group_stays(spark, sf_dir, documents):
    docs = as_frame(spark, documents)
    kept = pipeline.without_near_copies(spark, docs, sf_dir).collect()
    ids = Counter(r.doc_id for r in kept)
    assert ids[6] == 1 and ids[1] == 1 and 2 not in ids and 3 not in ids
    assert [r.text for r in kept if r.doc_id == 7] == [prose(4, 30)]
    from tallyward.llm.near_query import fingerprint_groups

    roots = fingerprint_groups(docs).select("root").distinct().count()
    assert len(kept) == roots


def same_hash_texts(spark, n=200_000):
    """Two texts whose 32-bit hashes are equal."""
    from pyspark.sql import functions as F

    texts = spark.range(n).select(F.concat(F.lit("word"), F.md5(F.col("id").cast("string"))).alias("text"))
    return list(texts.groupBy(F.hash("text")).agg(F.collect_list("text").alias("two")).filter(F.size("two") > 1).first().two)


def test_rows_without_id_are_not_taken_for_copies(spark, sf_dir):
    from tallyward.llm.suffix_buckets import remove_repeats

    one, two = same_hash_texts(spark)
    docs = as_frame(spark, [(None, t + " " + prose(301 + i, 90), "en", "a") for i, t in enumerate((one, two))] + [(None, one, "en", "a"), (None, two, "en", "a")])
    kept = pipeline.without_benchmark(spark, docs, sf_dir)
    assert kept.count() == 4
    assert pipeline.without_near_copies(spark, docs, sf_dir).count() == 4
    found = remove_repeats(docs, length=30, gram=8).collect()  # each text of 36 letters occurs twice in one row less its prose
    assert sorted(r.n_removed for r in found) == [36, 36, 36, 36]


def near_copies(spark, rows):
    docs = as_frame(spark, [(i, t, "en", "a") for i, t in enumerate(rows)])
    return {r.doc_id for r in pipeline.without_near_copies(spark, docs, "").collect()}


def test_near_copies_go_and_others_stay(spark):
    base = prose(80, 4000)
    rows = [base, base, base.upper(), base + " end", prose(81, 4000), prose(82, 50), "", " ", None]
    assert near_copies(spark, rows) == {0, 4, 5, 6}


def test_leaking_documents_go(spark, sf_dir, documents):
    kept = pipeline.without_benchmark(spark, as_frame(spark, documents), sf_dir).collect()
    gone = Counter(r[0] for r in documents) - Counter(r.doc_id for r in kept)
    assert gone == Counter([8, 9, 10, 11, 12, None])


def test_secrets_are_replaced(spark, sf_dir, documents):
    docs = as_frame(spark, documents)
    out = {(r.doc_id, r.n_chars): r.text for r in pipeline.without_secrets(spark, docs, sf_dir).collect()}
    assert len(out) == len({(d, t) for d, t, *_ in documents})
    sixteen = next(t for (d, _), t in out.items() if d == 16)
    assert sixteen == '[assign]" [access] [hex] TOKEN: short api-key'
    assert all(n == (None if t is None else len(t)) for (_, n), t in out.items())


@pytest.mark.parametrize("given", [True, False])
def test_whole_run_is_the_stages_one_after_another(spark, sf_dir, given):
    folder = GIVEN if given else sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, step in pipeline.STAGES:
        before, docs = docs, spark.createDataFrame(step(spark, docs, folder).collect() or [], step(spark, docs, folder).schema)
    assert set(before.columns) < set(docs.columns)
    key = lambda frame: Counter((r.doc_id, r.text, r["size"], r.copy) for r in frame.collect())
    assert key(pipeline.run(spark, folder)) == key(docs)
    compiled = [(r, re.compile(r.pattern, r.flags)) for r in BASE_RULES.rules]
    assert not any(scan_text(r.text, compiled) for r in docs.collect())
