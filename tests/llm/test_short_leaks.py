"""Documents that are shorter than the item they leak."""

from tallyward.llm.decontaminate import leaks
from tests.llm.conftest import as_frame, prose


def test_item_without_its_ends_leaks(spark):
    item, other = prose(80, 30), prose(81, 12)
    words = item.split()
    texts = [item, " ".join(words[1:29]), " ".join(words[:25]), " ".join(words[:24]), " ".join(words[2:15] + ["x"] + words[16:]), other]
    texts += [" ".join(words[3:] + ["y"] * 9), " ".join(other.split()[:10]), " ".join(other.split()[:3])]
    items = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, round(r.similarity, 9)) for r in leaks(as_frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), items).collect()}
    want = {}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for i, t in enumerate(texts):
        for number, v in ((1, words), (2, other.split())):
            w = t.split()
            size, best = min(len(w), len(v)), (0, None)
            for s in range(len(w) - size + 1):
                a, b = grams(w[s : s + size]), grams(v)
                same = len(a & b)
                similarity = same / (max(0, size - 4) + len(b) - same)
                if similarity >= 0.8 and similarity > best[0]:
                    best = (similarity, (s, size, round(similarity, 9)))
            if best[1]:
                want[i, number] = best[1]
    assert got == want and (1, 1) in want and (3, 1) not in want
    assert got[1, 1] == (0, 28, round(24 / 26, 9))
