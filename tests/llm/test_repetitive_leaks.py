"""Leaks between texts that repeat shingles, and lines that many documents and items have in common."""

import random
from collections import Counter

import pytest

from tallyward.llm import decontaminate
from tallyward.llm.decontaminate import leaks
from tests.llm.conftest import as_frame, prose


def brute(texts, items):
    want = {}
    for i, t in enumerate(texts):
        for number, v in items:
            w, v = t.split(), v.split()
            k = min(5, len(v))
            grams = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            own = Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1))
            n = sum(own.values())
            size = min(n, len(grams))
            best = None
            for s in range(len(grams) - size + 1):
                same = sum((Counter(grams[s : s + size]) & own).values())
                similarity = same / (size + n - same)
                if similarity >= 0.8 and (best is None or similarity > best[0]):
                    best = (similarity, s, size + k - 1)
            if best:
                want[i, number] = (best[1], best[2], round(best[0], 9))
    return want


def found(spark, texts, items):
    frame = spark.createDataFrame(items, "item_id long, text string")
    rows = leaks(as_frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), frame).collect()
    return {(r.doc_id, r.item_id): (r.start, r.n_words, round(r.similarity, 9)) for r in rows}


def test_periodic_texts(spark):
    items = [(1, " ".join("xy"[i % 2] for i in range(13))), (2, " ".join("abc"[i % 3] for i in range(40))), (3, prose(5, 45))]
    v = items[2][1].split()
    texts = [" ".join("yx"[i % 2] for i in range(13)), items[0][1], " ".join("yx"[i % 2] for i in range(400)), " ".join("cab"[i % 3] for i in range(39))]
    # One passage of the item gives way to one word over and over, as often as the similarity allows and once more.
    texts += [" ".join(v[: 45 - r] + ["z"] * r) for r in (4, 5)] + [" ".join(["q q q q q q"] + v)]
    texts += [" ".join("xy"[i % 2] for i in range(11)), prose(6, 30)]
    got = found(spark, texts, items)
    assert got == brute(texts, items)
    assert got[0, 1] == (0, 13, 0.8) and (3, 2) in got and (4, 3) in got


@pytest.mark.parametrize("seed", [1, 2])
def test_few_words_at_random(spark, seed):
    """Texts over two or three words, so that shingles repeat at random; some are items with a few words changed."""
    rng = random.Random(seed)
    some = lambda n, letters: [rng.choice(letters) for _ in range(n)]
    items = [(i, some(rng.randrange(8, 40), "ab" if i % 2 else "abc")) for i in range(25)]
    texts = [some(rng.randrange(5, 60), "ab") for _ in range(40)]
    for _, v in items:
        w = list(v)
        w[rng.randrange(len(w))] = rng.choice("abz")
        texts.append(some(rng.randrange(6), "abc") + w + some(rng.randrange(6), "abc"))
        texts.append(w[: -rng.randrange(1, 4)])
    items, texts = [(i, " ".join(v)) for i, v in items], [" ".join(t) for t in texts]
    want = brute(texts, items)
    assert found(spark, texts, items) == want and len(want) > 15


def test_plain_texts_meet_by_the_index_alone(spark, monkeypatch):
    """Without the other way, pairs without repeats are all found."""
    monkeypatch.setattr(decontaminate, "_by_rare_shingles", lambda kinds, own, known, similar: kinds.limit(0).selectExpr("cls", "bigint(n) AS item"))
    rng = random.Random(3)
    items = [(i, prose(100 + i, rng.randrange(20, 80))) for i in range(60)]
    texts = []
    for _, v in items:
        w = v.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [f"{prose(rng.randrange(10**6), 20)} {' '.join(w)}", " ".join(w[: int(len(w) * 0.9)])]
    want = brute(texts, items)
    assert found(spark, texts, items) == want and len(want) > 40


def test_common_line_gives_a_row_for_each_size(spark, monkeypatch):
    """A line in all documents and items: places are kept by size of item, never by item."""
    line = prose(7, 12)
    items = [(i, f"{prose(200 + i, 30)} {line}") for i in range(50)]
    texts = [f"{line} {prose(400 + i, 60)}" for i in range(60)]
    staged = {}
    plain = decontaminate.stage

    def stage(df, label):
        staged[label] = out = plain(df, label)
        return out

    monkeypatch.setattr(decontaminate, "stage", stage)
    assert found(spark, texts, items) == {}
    assert staged["windows"].count() == 0
    assert staged["hits"].join(staged["item-shingles"].select("n", "h").distinct(), "h").count() == 60 * 8
