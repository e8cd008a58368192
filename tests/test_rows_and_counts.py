import statistics

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import rows
from tallyward.operators import counts, gini, reshape, rows as ops


def test_value_filter_drops_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert rows(ops.drop_values(df, "v", ["a"])) == [("b",)]
    assert ops.drop_values(df, "v", []).count() == 3


def test_not_in_keeps_null_unless_listed(spark):
    df = spark.createDataFrame([("a",), (None,)], "v string")
    without = spark.createDataFrame([("a",)], "k string")
    with_null = spark.createDataFrame([("a",), (None,)], "k string")
    assert rows(ops.not_in(df, "v", without, "k")) == [(None,)]
    assert rows(ops.not_in(df, "v", with_null, "k")) == []


def test_left_match_joins_null_with_null(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, n int")
    b = spark.createDataFrame([("x", "hit"), (None, "null hit")], "k string, v string")
    assert rows(ops.left_match(a, b, {"k": "k"})) == [(None, 2, "null hit"), ("x", 1, "hit")]


def test_left_match_on_two_renamed_keys(spark):
    a = spark.createDataFrame([("x", "l1"), ("y", "l2")], "code string, label string")
    b = spark.createDataFrame([("x", "l1", 5), ("y", "other", 6)], "geo string, label string, n int")
    assert rows(ops.left_match(a, b, {"code": "geo", "label": "label"})) == [("x", "l1", 5), ("y", "l2", None)]


def test_right_match_keeps_every_right_row(spark):
    a = spark.createDataFrame([("x", "A")], "code string, traj string")
    b = spark.createDataFrame([("x", "l1"), ("y", "l2")], "geo string, label string")
    assert rows(ops.right_match(a, b, {"code": "geo"}), "code", "label", "traj") == [("x", "l1", "A"), ("y", "l2", None)]


def test_group_maximum_flags_all_ties(spark):
    df = spark.createDataFrame([("c", "a", 3), ("c", "b", 3), ("c", "d", 1), ("e", "f", 0)], "city string, k string, n int")
    out = ops.flag_group_maximum(df, "city", {"top": "n"})
    assert rows(out, "k", "top") == [("a", 1), ("b", 1), ("d", 0), ("f", 1)]


def test_top_per_group_puts_null_last(spark):
    df = spark.createDataFrame([("g", "a", None), ("g", "b", 5), ("g", "c", 3), ("h", "z", None), ("h", "y", None)], "g string, k string, n long")
    assert rows(ops.top_per_group(df, ["g"], "n", "k")) == [("g", "b", 5), ("h", "y", None)]


@pytest.mark.parametrize("keep_adaptive", ["true", "false"])
def test_few_keys_are_no_shuffle_keys(spark, keep_adaptive):
    """With a tiny broadcast threshold the side with a row for each of few keys is still not met by a shuffle."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
        spark.conf.set("spark.sql.adaptive.enabled", keep_adaptive)
        df = spark.range(1000).selectExpr("id", "concat('c', id % 3) AS city", "id % 17 AS n")
        out = ops.flag_group_maximum(df, "city", {"top": "n"})
        out.collect()
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_top_per_group_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("t", "b", 3), ("t", "a", 3), ("t", "c", 1)], "g string, k string, n int")
    assert rows(ops.top_per_group(df, ["g"], "n", "k")) == [("t", "a", 3)]


def test_complete_stays_inside_its_year(spark):
    df = spark.createDataFrame(
        [("1", "a1", "x", "m1", 2), ("1", "a2", "y", "m2", 1), ("1", "a3", "x", "m1", 1), ("2", "a1", "x", "m3", 4), ("2", "a2", "x", "m3", 5)],
        "year string, area string, category string, month string, n long",
    )
    out = counts.complete(df, ["year"], "area", ["category", "month"])
    assert out.filter("year = '1'").count() == 3 * 2 * 2
    assert out.filter("year = '2'").count() == 2 * 1 * 1
    assert out.agg(F.sum("n")).first()[0] == 13
    assert out.filter("year = '1' and area = 'a3' and category = 'y'").agg(F.sum("n")).first()[0] == 0


def test_complete_treats_null_as_a_level_and_fills_null_counts(spark):
    df = spark.createDataFrame(
        [("1", "a", None, 2), ("1", "b", "x", None)], "year string, area string, category string, n long"
    )
    out = counts.complete(df, ["year"], "area", ["category"])
    assert rows(out, "area", "category", "n") == [("a", None, 2), ("a", "x", 0), ("b", None, 0), ("b", "x", 0)]


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "k string, n long")
    assert rows(counts.share_of_total(df)) == [("a", 1, 25.0), ("b", 3, 75.0)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 6), min_size=1, max_size=30))
def test_quantiles_match_a_sorted_list(spark, values):
    freq = counts.value_frequencies(spark.createDataFrame([("g", v) for v in values], "g string, v long"), ["g"], "v")
    got = counts.exact_quantiles(freq, ["g"], "v", {"q1": 0.25, "median": 0.5, "q9": 0.9}).first()
    assert got["median"] == statistics.median(values)
    assert got["q1"] == pytest.approx(np.quantile(values, 0.25))
    assert got["q9"] == pytest.approx(np.quantile(values, 0.9))


def _gini(spark, values, **options):
    freq = counts.value_frequencies(spark.createDataFrame([("g", v) for v in values], "g string, n long"), ["g"], "n")
    return gini.gini_from_frequencies(freq, ["g"], **options).first()["gini"]


def _direct(values, generalized=True):
    n, c = len(values), sum(values)
    weighted = sum(i * v / c for i, v in enumerate(sorted(values), start=1))
    spread = 2 * weighted - n - 1
    return max(1 / c, 1 / n) * spread - max(n / c, 1) + 1 if generalized else spread / n


@pytest.mark.parametrize("values", [[1, 2, 3, 4], [0, 0, 5], [0, 0, 0, 1, 1], [7, 7, 1, 0, 0, 3]])
def test_gini_matches_the_rank_formula(spark, values):
    assert _gini(spark, values, correction="none") == pytest.approx(_direct(values))
    n = len(values)
    assert _gini(spark, values, correction="n") == pytest.approx(_direct(values) * n / (n - 1))


def test_gini_edge_cases(spark):
    assert _gini(spark, [3, 3, 3, 3]) == pytest.approx(0, abs=1e-12)
    assert _gini(spark, [0, 0, 0]) is None
    assert _gini(spark, [5]) is None
    assert _gini(spark, [0, 0, 0, 9], correction="n") == pytest.approx(1)
    assert _gini(spark, [0] * 9 + [3], correction="min") == pytest.approx(1)
    assert _gini(spark, [0] * 7 + [1] * 3, correction="none") == pytest.approx(0, abs=1e-12)


def test_gini_is_scale_free_above_one_incident_per_cell(spark):
    assert _gini(spark, [1, 2, 3, 10]) == pytest.approx(_gini(spark, [10, 20, 30, 100]))


def test_gini_rejects_an_unknown_correction(spark):
    with pytest.raises(ValueError):
        _gini(spark, [1, 2], correction="half")


def test_pivot_and_back(spark):
    df = spark.createDataFrame([("a", "m1", 1), ("a", "m2", 2), ("b", "m1", 3), ("b", "m2", 4)], "k string, m string, n long")
    wide = reshape.widen(df, ["k"], "m", "n", {"m1": "first", "m2": "second"})
    assert rows(wide, "k", "first", "second") == [("a", 1, 2), ("b", 3, 4)]
    assert rows(reshape.lengthen(wide, ["k"], "m", "n")) == [("a", "first", 1), ("a", "second", 2), ("b", "first", 3), ("b", "second", 4)]


def test_pivot_two_values_names(spark):
    df = spark.createDataFrame([("a", "m1", 1, 5), ("a", "m2", 2, 6)], "k string, m string, n long, t long")
    wide = reshape.widen_many(df, ["k"], "m", ["n", "t"], {"m1": "one", "m2": "two"})
    assert rows(wide, "k", "n_one", "n_two", "t_one", "t_two") == [("a", 1, 2, 5, 6)]


def test_split_period_overwrites_year(spark):
    df = spark.createDataFrame([("2020-03", "1999")], "month string, year string")
    assert rows(reshape.split_period(df), "year", "month") == [("2020", "03")]


def test_split_stat_name(spark):
    df = spark.createDataFrame([("prop_feb_mar",), ("traj_jul_aug",)], "c string")
    out = reshape.split_stat_name(df, "c", {"prop": "prop_change", "traj": "count_change"})
    assert rows(out, "stat", "step") == [("count_change", "jul_aug"), ("prop_change", "feb_mar")]


def test_column_range(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["a", "b", "c", "d"])
    assert reshape.column_range(df, "b", "d") == ["b", "c", "d"]
