"""Hard negatives against all pairs: ties, copies, awkward rows, several dimensions, and many small parts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyward.llm import hard_negatives as hn
from tallyward.llm.hard_negatives import Cells, Halves, Parts, hard_negatives, visits, window

SHAPE = "vec_id long, embedding array<double>, label int, score string, part string, id string"


def brute(rows, step, positives=5, negatives=3):
    good = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if any(abs(256 * x) >= math.sqrt(2.0**63 / max(1, len(v))) - 2 for x in v):
            continue
        one = (label, [math.floor(256 * x) for x in v])
        good[i] = min(good.get(i, one), one)
    out = set()
    for a, (label, v) in good.items():
        if a % step:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in good.items() if i != a and len(w) == len(v)]
        scored.sort()
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out |= {(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(inside[:negatives])}
    return out


def found(spark, rows, step=5, **more):
    frame = spark.createDataFrame([(*r, "s", "p", "i") for r in rows], SHAPE).repartition(4)
    got = hard_negatives(frame, lambda i: i % step == 0, F.col("label"), **more).collect()
    rows = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got]
    assert len(rows) == len(set(rows))
    return set(rows)


def clustered(seed, n, dims, spread=0.2, labels=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, dims))
    return [(int(i), (middles[rng.integers(6)] + rng.normal(size=dims) * spread).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("part_rows", [16384, 40])
def test_clusters_copies_and_ties(spark, monkeypatch, part_rows):
    monkeypatch.setattr(hn, "PART_ROWS", part_rows)
    monkeypatch.setattr(hn, "CELL_ROWS", 8)
    monkeypatch.setattr(hn, "_WAVE", 4)
    rows = clustered(1, 300, 6)
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(150)]  # one cell of many copies
    rows += [(2000 + i, [round(x, 1) for x in rows[i][1]], i % 2) for i in range(40)]
    want = brute(rows, 5)
    assert want and found(spark, rows) == want


def test_awkward_rows(spark):
    rows = clustered(2, 60, 3) + clustered(3, 1, 3)
    rows += [(100, None, 1), (105, [1.0, None, 2.0], 1), (110, [1.0, math.nan, 0.0], 0), (115, [math.inf, 0.0, 0.0], 0), (120, [0.1, 0.2, 0.3], None)]
    rows += [(None, [0.1, 0.2, 0.3], 1), (125, [1e300, 0.0, 0.0], 1), (130, [0.0, 0.0, 0.0], 1), (135, [-5.0, 3.0, 1.0], 2)]
    rows += [(200 + i, [], i % 2) for i in range(4)] + [(300 + i, [float(i)], i % 2) for i in range(9)]
    rows += [(10, [9.0, 9.0, 9.0], 0), (10, [9.0, 9.0, 9.0], 0), (400, [3e6, -2e6, 1e6, 4e6], 0)]
    rows += [(401 + i, [3e6 - i / 7, -2e6 + i, 1e6 * i / 5, 4e6], i % 2) for i in range(9)]
    want = brute(rows, 5)
    assert found(spark, rows) == want


@pytest.mark.parametrize("rows", [[], [(0, None, 1)], [(0, [1.0, 2.0], 1)], [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)]])
def test_nothing_to_find(spark, rows):
    assert found(spark, rows) == set()


def test_random_vectors_without_structure(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)], rng.randrange(3)) for i in range(400)]
    assert found(spark, rows, step=10, positives=3, negatives=2) == brute(rows, 10, 3, 2)


def test_visits_in_falling_order():
    rng = np.random.default_rng(1)
    first, second = rng.normal(size=7), np.append(rng.normal(size=5), -np.inf)
    got = list(visits(first, second))
    assert [t for t, _, _ in got] == sorted((a + b for a in first for b in second[:-1]), reverse=True)
    assert len({(i, j) for _, i, j in got}) == 35 and all(abs(first[i] + second[j] - t) < 1e-12 for t, i, j in got)


def test_bounds_hold_and_few_rows_are_scored():
    rows = clustered(5, 4000, 8, spread=0.05)
    ids, labels = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    v = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    halves = Halves(v.astype(np.float64), 12)
    cells = Cells(halves, ids, labels, v)
    scored = 0
    for q in range(0, 4000, 400):
        seen = [len(p) for _, _, p in cells.waves(v[q], np.inf, int(labels[q]), None, q)]
        score, other = cells.positives(q, int(labels[q]), v[q], hn._NONE, 5)
        own = [(-int(v[q] @ v[i]), i) for i in range(4000) if labels[i] == labels[q] and i != q]
        assert [(-s, i) for s, i in zip(score.tolist(), other.tolist())] == sorted(own)[:5]
        assert sum(seen) == len(own)
        need = -sorted(own)[4][0]
        done = 0
        for bound, _, places in cells.waves(v[q], np.inf, int(labels[q]), None, q):
            done += len(places)
            if bound < need:
                break
        scored += done / len(own)
    assert scored / 10 < 0.6


def test_parts_cover_cells():
    parts = Parts([(0, 0, 10), (0, 1, 40000), (1, 0, 9000), (1, 1, 9000), (2, 0, 1)])
    assert parts.of == {(0, 0): (0, 1), (0, 1): (1, 3), (1, 0): (4, 1), (1, 1): (5, 1), (2, 0): (5, 1)}
    assert window(10) == (5, 9) and window(0) == (0, 0) and window(-3)[0] > window(-3)[1] and window(3) == (2, 2)
