"""Spelling variants against all pairs of words, with filters in one window and in many."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyward.llm import spelling
from tallyward.llm.spelling import Layout, _letters_used, misspelt, near_words, probed, roots, variants, vocabulary
from tallyward.llm.spelling_query import op11_spelling_variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def expected(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def made_words(seed=2, n=400):
    rng = random.Random(seed)
    letters = "abcéÿàz"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(n)}
    words |= {"a" * k for k in (63, 64, 65, 66, 5000, 5001)} | {"a" * 64 + "b", "ÿ" * 70, "ÿ" * 69 + "a"}
    return {w: rng.choice([1, 1, 2, 3, 5, 9, 40]) for w in words}


@pytest.mark.parametrize("most_blocks", [1 << 20, 17])
def test_variants_equal_all_pairs(spark, most_blocks):
    counts = made_words()
    found = variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3), most_blocks)
    rows = [tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(counts) and set(rows) == expected(counts)


def test_edits_in_slices(monkeypatch):
    words = [w for w in made_words(3, 200)]
    layout = Layout(Counter(min(len(w), spelling.LAST_SHARD) for w in words))
    everything = np.full(layout.total, np.uint64(2**64 - 1))
    letters = "abcéÿàz"
    want = Counter(probed(words, letters, layout, 0, everything))
    monkeypatch.setattr(spelling, "_EDITS", 50)
    assert Counter(probed(words, letters, layout, 0, everything)) == want
    # Full filters let every edit through: each deletion once, and each replacement by a later letter, if its length occurs.
    made = Counter()
    for i, w in enumerate(words):
        if layout.meets(len(w) - 1, 0, layout.total):
            made.update({(i, w[:k] + w[k + 1 :]) for k in range(len(w))})
        made.update((i, w[:k] + c + w[k + 1 :]) for k in range(len(w)) for c in letters if c > w[k])
    assert want == made


def test_roots_of_long_chains(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(50)] + [("x", "w20"), ("y", "z")]
    got = {r.word: r.root for r in roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {f"w{i}": "w50" for i in range(50)} | {"x": "w50", "y": "z"}


def brute(docs):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_vocabulary_in_small_flushes(spark, documents, monkeypatch):
    monkeypatch.setattr(spelling, "_FLUSH", 3)
    docs = [(d, t) for d, t, _, _ in documents] + [(i, "Étude ÉTUDE étude×ab xyzzy_xyzzy Ünïcode1Ünïcode") for i in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.word: r.n for r in vocabulary(frame, misspelt).collect()} == brute(docs)


def test_awkward_documents(spark, sf_dir, documents):
    rows = op11_spelling_variants(spark, sf_dir).collect()
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(rows) == len(got) and got == expected(brute([(d, t) for d, t, _, _ in documents]))


def test_letters_used(spark):
    assert _letters_used(spark.createDataFrame([("abé",), ("zÿ",)], "word string")) == "abzéÿ"
    assert near_words(spark.createDataFrame([], "word string, n long")).collect() == []
