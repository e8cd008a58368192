"""Buckets of the block index: their number follows the text, and changes no result."""

import random

import pytest

from tallyward.llm import block_anchors

from .conftest import as_frame, prose


@pytest.fixture
def docs(spark):
    rng = random.Random(5)
    shared = [prose(900 + i, 60) for i in range(4)]
    rows = [(i * 1_000_003 - 9_000_000, f"{prose(i, 40)} {rng.choice(shared)} {prose(500 + i, 30)}", "en", "a") for i in range(30)]
    return as_frame(spark, [*rows, (None, shared[0], "en", "a"), (77, None, "en", "a")]).repartition(4)


def test_number_of_buckets_follows_the_bytes(spark, docs):
    named = docs.select("doc_id", "text")
    total = sum(len(r.text.encode()) for r in named.collect() if r.text)
    least = spark.sparkContext.defaultParallelism
    assert block_anchors.buckets_for(named) == least
    assert block_anchors.buckets_for(named, size=100) == -(-total // 100)
    assert block_anchors.buckets_for(named, size=100, most=20) == 20
    assert block_anchors.buckets_for(named.limit(0)) == least


def test_result_is_the_same_with_any_number_of_buckets(docs, monkeypatch):
    found = []
    for n in (1, 3, 400):
        monkeypatch.setattr(block_anchors, "buckets_for", lambda _, n=n: n)
        found.append(sorted(map(str, block_anchors.remove_repeats(docs).collect())))
    assert found[0] == found[1] == found[2]
    assert any("n_removed=60" in row for row in found[0])
