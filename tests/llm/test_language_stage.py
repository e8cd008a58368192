"""The language stage: what the network rejects, and what stays without one."""

import corpus_pipeline as pipeline
from tests.llm.conftest import as_frame

TONGUES = {"aa": "babo bibu bobe buba", "ee": "kexo kixu koxe kuxa", "ii": "zyno zynu zyne zyna"}


def pages(lang, i):
    words = TONGUES[lang].split()
    return " ".join(words[(i * 7 + j * j + j // 3) % 4] for j in range(300))


def test_network_rejects_what_is_in_no_one_language(spark, sf_dir):
    rows = [(i, pages(lang, i), lang, "a") for n, lang in enumerate(TONGUES) for i in range(n * 200, n * 200 + 60)]
    third = [pages(lang, 1)[:256].ljust(256, "b") for lang in TONGUES]
    rows += [(900, "".join(third), None, "a"), (901, pages("ee", 5), None, "a"), (902, "12 34", "aa", "a")]
    kept = {r.doc_id for r in pipeline.with_language(spark, as_frame(spark, rows), sf_dir).collect()}
    assert kept == {r[0] for r in rows} - {900, 902}


def test_texts_with_letters_stay_without_labels(spark, sf_dir):
    docs = as_frame(spark, [(1, "some text", None, "a"), (2, "12 34", None, "a"), (3, None, None, "a"), (4, "é", None, None)])
    kept = pipeline.with_language(spark, docs, sf_dir)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 4}
