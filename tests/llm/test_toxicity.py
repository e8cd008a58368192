"""Toxicity: folding, matching against a plain search, learning, and held-out figures."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyward.llm import toxic_lexicon
from tallyward.llm.toxic_lexicon import Lexicon, curve_value, fit_curve, folded, heat, hits, learn, scores
from tallyward.llm.toxicity_query import op13_toxic_lexicon


@pytest.mark.parametrize(
    "text, words",
    [
        ("You 1d10t, id!ot!", "you idiot idiot"),
        ("ІDІОТ ｉｄｉｏｔ id​iot", "idiot idiot idiot"),
        ("12 34ab $5 wow!! a_b", "eaab wow a b"),
        ("É c'est ſ", "é c est ſ"),
        ("", ""),
        ("12 !! --", ""),
    ],
)
def test_folding(text, words):
    assert folded(text) == (f" {words} " if words else "")


def plain_hits(plain, lexicon):
    """The same by looking at every place with every entry."""
    spared = set()
    for p in lexicon.exceptions:
        for at in range(len(plain)):
            if plain.startswith(p, at):
                spared |= set(range(at + 1, at + len(p) - 1))
    out = {}
    for at in range(len(plain)):
        for e, w in lexicon.entries.items():
            if e not in lexicon.exceptions and plain.startswith(e, at) and at + 1 not in spared:
                out[at + 1] = max(w, out.get(at + 1, w))
    return out


def test_hits_equal_a_plain_search():
    rng = random.Random(4)
    parts = ["ab", "ba", "aab", "abba", "b", "bab"]
    for _ in range(300):
        words = [rng.choice(parts) + rng.choice(parts) for _ in range(rng.randrange(30))]
        plain = folded(" ".join(words))
        entries = {f" {rng.choice(parts)}{rng.choice(parts)} ": 1.0 + rng.random() for _ in range(3)} | {f" {rng.choice(parts)}": rng.random()}
        known = words or ["ab"]
        exceptions = [f" {rng.choice(known)} {rng.choice(known)} " for _ in range(2)]
        lexicon = Lexicon(entries, exceptions)
        assert hits(plain, lexicon.automaton()) == plain_hits(plain, lexicon)


def test_exceptions_and_length():
    lexicon = Lexicon({" trash ": 4.0, " clow": 2.0}, [" trash bin "])
    made = lexicon.automaton()
    assert heat(folded("Trash bin day"), made) == 0
    assert heat(folded("trash talk"), made) > heat(folded("trash " + "word " * 500), made) > 0
    assert hits(folded("clowns clown"), made) == {1: 2.0, 8: 2.0}
    assert Lexicon({}).automaton() is None and heat(folded("a b"), None) == 0


def test_curve():
    x = np.concatenate([np.zeros(90), np.full(10, 3.0)])
    y = np.concatenate([np.zeros(89), [1.0], np.ones(10)])
    curve = fit_curve(x, y, np.ones(100))
    assert curve_value(0, curve) < 0.05 < 0.9 < curve_value(3, curve)
    assert fit_curve(x, 1 - y, np.ones(100))[1] == 0
    assert curve_value(1e6, (-4.0, 2.0)) == 1 and curve_value(-1e6, (-4.0, 2.0)) == 0


def made_rows(n=400, seed=1):
    """Toxic rows hold some of the words ``zork...``; clean rows hold ``zorkin`` only in ``gentle zorkin``."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice("alpha beta gamma delta iota".split()) for _ in range(40)]
        toxic = int(i % 4 == 0)
        if toxic:
            words[5], words[20] = "zorkin", rng.choice(["Z0RKUM", "zorkel"])
        elif i % 3 == 0:
            words[9:11] = ["gentle", "zorkin"]
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def test_learning_finds_words_and_exceptions(spark):
    docs, labels = made_rows()
    frame = spark.createDataFrame(docs + docs[:30], "doc_id long, text string")
    marks = spark.createDataFrame(labels + labels[:9] + [(3, None), (None, 1), (5, 7)], "doc_id long, toxic int")
    lexicon = learn(frame, marks, F.lit(True))
    assert " zorkum " in lexicon.entries and " zorkel " in lexicon.entries
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "alpha gentle zorkin beta"), (4, "zorkel alpha zorkum"), (4, "zorkel alpha zorkum")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in scores(odd, lexicon, ["doc_id"]).collect()}
    assert got[1] == got[2] < 0.3 <= got[4] <= 1
    assert got[3] < got[4]


def test_learning_is_bounded_and_skips_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(toxic_lexicon, "SAMPLE", 20)
    docs, labels = made_rows()
    frame = spark.createDataFrame(docs + [(i, "same text zorkin") for i in range(1000, 1400)], "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(i, 1) for i in range(1000, 1400)], "doc_id long, toxic int")
    keep = F.col("doc_id") % 2 == 0
    sample, counts = toxic_lexicon.labelled_sample(frame, marks, keep, "doc_id", "text", "toxic")
    rows = sample.collect()
    assert sorted(r.toxic for r in rows) == [0] * 20 + [1] * 20
    allowed = {t for i, t in docs if i % 2 == 0} | {"same text zorkin"}
    assert all(r.text in allowed for r in rows) and counts[1] == len({t for i, t in docs if i % 4 == 0}) + 1


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1), (2, 1)]])
def test_without_both_labels_all_scores_are_zero(spark, labels):
    frame = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    lexicon = learn(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    assert lexicon is None
    assert [r.score for r in scores(frame, lexicon, ["doc_id"]).collect()] == [0.0, 0.0]


def test_awkward_documents(spark, sf_dir, documents):
    rows = op13_toxic_lexicon(spark, sf_dir).collect()
    held = sorted((str(d), zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2) for d, _, _, _ in documents)
    assert sorted((str(r.doc_id), r.held_out) for r in rows) == held
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_figures(spark):
    folder = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(label[r.doc_id], r.predicted) for r in op13_toxic_lexicon(spark, folder).collect() if r.held_out and r.doc_id in label]
    both = sum(a and b for a, b in rows)
    assert both / sum(a for a, _ in rows) >= 0.85 and both / sum(b for _, b in rows) >= 0.85
