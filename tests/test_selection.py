"""Exact quantiles by narrowing brackets against sorted lists: ties, outliers, NaN, NULL keys, hot groups."""

import math
import random

import pytest

from tallyward.operators.selection import quantiles

AT = {"low": 0.1, "median": 0.5, "high": 0.9, "least": 0.0, "most": 1.0}


def by_sorting(rows):
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    out = {}
    for k, values in groups.items():
        values.sort(key=lambda v: (math.isnan(v), v))
        got = []
        for p in AT.values():
            place = (len(values) - 1) * p
            a, b, part = values[math.floor(place)], values[min(math.floor(place) + 1, len(values) - 1)], place - math.floor(place)
            got.append(a if part == 0 else a * (1 - part) + b * part)
        out[k] = got
    return out


def made():
    rng = random.Random(7)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(3000)]
    rows += [("ties", float(rng.choice([1, 1, 1, 2, 3]))) for _ in range(900)]
    rows += [("one value", 4.5)] * 700
    rows += [("wide", rng.choice([1e300, -1e300, 1e-300, 5.0, 6.0, 7.5]) * rng.random()) for _ in range(800)]
    rows += [(None, rng.random()) for _ in range(400)] + [("small", float(i)) for i in range(7)] + [("none", None)] * 3
    rows += [("odd", v) for v in [math.nan] * 30 + [math.inf] * 30 + [-math.inf] * 30 + [0.0] * 200]
    return rows


@pytest.mark.parametrize("limit, accuracy", [(10**6, 2000), (100, 2000)])
def test_quantiles_equal_sorting(spark, limit, accuracy):
    rows = made()
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: [r[n] for n in AT] for r in quantiles(frame, ["k"], "v", AT, limit, accuracy).collect()}
    want = by_sorting(rows)
    assert set(got) == set(want)
    for k, values in want.items():
        for a, b in zip(got[k], values):
            assert a == pytest.approx(b, rel=1e-12, nan_ok=True), k


def test_no_rows(spark):
    assert quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", AT).collect() == []
