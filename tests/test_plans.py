import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallyward.plans import change, composition, distribution, inequality, panel as panels, quality, reconcile, trajectories, trends
from tallyward.plans.panel import build_panel

INCIDENT = "reported_by string, month string, year string, category string, area_code string, x double, y double"
OUT = ("minor", "nuisance")


def incident(month, category, area, by="p1"):
    return (by, month, month[:4] if month else None, category, area, None if area is None else 1.0, None if area is None else 2.0)


@pytest.fixture(scope="module")
def incidents(spark):
    data = []
    for year, factor in (("1999", 1), ("2000", 2)):
        for m in range(1, 13):
            month = f"{year}-{m:02d}"
            data += [incident(month, "theft", "E1")] * (factor * m)
            data += [incident(month, "fraud", "E2")] * (m % 3)
            data += [incident(month, "minor", "W1")] * 2
    data += [incident("2000-03", "fraud", "W1"), incident("1999-04", None, "E1")]
    data += [incident("2000-02", "theft", None), incident("2000-02", "theft", "E1", by="gone"), incident("2000-02", "theft", None, by=None)]
    data += [incident("2000-05", "arson", "E9"), incident("2000-05", "theft", "9N")]
    return spark.createDataFrame(data, INCIDENT)


@pytest.fixture(scope="module")
def boundaries(spark):
    codes = [("E1", "Alpha"), ("E2", "Beta"), ("W1", "Gamma"), ("E9", "Omega district"), ("9N", "North"), ("E5", "Silent")]
    return spark.createDataFrame(codes, "geo_code string, geo_label string")


@pytest.fixture(scope="module")
def panel(incidents, boundaries):
    return build_panel(incidents, boundaries, ["gone"], "Omega", "9")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([("E1", "A"), ("E2", "A"), ("W1", "B")], "area_code string, traj string")


def test_dense_panel(panel):
    dense = panel.dense()
    sizes = {r.year: r.n for r in dense.groupBy("year").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"1999": 3 * 12 * 4, "2000": 3 * 12 * 4}
    assert dense.filter("category = 'arson'").agg(F.sum("n")).first()[0] == 0, "level of an excluded area stays, as zeros"
    assert dense.filter("area_code in ('E9', '9N')").count() == 0
    assert dense.filter("year = '1999' and category is null").agg(F.sum("n")).first()[0] == 1
    total = 78 + 156 + 12 * 2 + 24 * 2 + 2
    assert dense.agg(F.sum("n")).first()[0] == total


def test_usable_incidents_drop_missing(incidents):
    kept = panels.usable_incidents(incidents, ["gone"])
    assert kept.filter("area_code is null or reported_by is null or reported_by = 'gone'").count() == 0


def test_reconciliation(panel, boundaries):
    kept = reconcile.analysed_boundaries(boundaries, "Omega")
    assert {r.geo_code for r in kept.collect()} == {"E1", "E2", "W1", "E5"}
    assert rows(reconcile.missing_areas(panel, kept), "geo_code", "year") == [("E5", "1999"), ("E5", "2000")]
    assert rows(reconcile.area_counts(panel, kept)) == [("boundaries", 4), ("boundaries_seen", 3), ("panel_1999", 3), ("panel_2000", 3)]
    assert {r.geo_code for r in reconcile.seen_boundaries(panel, kept).collect()} == {"E1", "E2", "W1"}


def test_trend_total_leaves_out_minor(panel):
    got = {(r.category, r.year, r.month): r.n for r in trends.trend_table(panel, OUT, "all").collect()}
    assert got[("all", "2000", "03")] == 6 + 0 + 1
    assert got[("minor", "2000", "03")] == 2
    assert got[("arson", "2000", "05")] == 0
    assert {m for _, _, m in got} == {f"0{i}" for i in range(2, 9)}
    assert {c for c, _, _ in got} == {"theft", "fraud", "minor", "arson", None, "all"}


def test_long_run_positions(panel):
    got = trends.long_run_trend(panel, ["theft"], drop_periods=["2000-11", "2000-12"])
    assert [(r.month, r.n, r.position) for r in got.orderBy("month").collect()][12:14] == [("2000-01", 2, 13), ("2000-02", 4, 14)]
    assert got.count() == 22
    main = {r.month: r.n for r in trends.main_measure_trend(panel, OUT).collect()}
    assert main["2000-03"] == 7 and "1999-04" in main


def test_inequality_against_dense(panel):
    def direct(values, factor=True):
        n, c = len(values), sum(values)
        if c == 0:
            return None
        w = sum(i * v / c for i, v in enumerate(sorted(values), 1))
        g = max(1 / c, 1 / n) * (2 * w - n - 1) - max(n / c, 1) + 1
        return max(0.0, g * n / (n - 1))

    cells = {}
    for r in panel.dense().collect():
        cells.setdefault((r.category, r.month), []).append(r.n)
    got = {(r.category, r.month): r.gini for r in inequality.gini_by_category(panel).collect()}
    assert got.keys() == cells.keys()
    for key, values in cells.items():
        want = direct(values)
        assert (got[key] is None) if want is None else got[key] == pytest.approx(want, abs=1e-12)

    total = {r.month: r.gini for r in inequality.gini_total(panel, OUT, "cell").collect()}
    by_area = {r.month: r.gini for r in inequality.gini_total(panel, OUT, "area").collect()}
    month = [r for r in panel.dense().filter("month = '2000-07' and category not in ('minor')").collect()]
    assert total["2000-07"] == pytest.approx(direct([r.n for r in month]))
    areas = {}
    for r in month:
        areas[r.area_code] = areas.get(r.area_code, 0) + r.n
    assert by_area["2000-07"] == pytest.approx(direct(list(areas.values())))
    assert all(v is None or 0 <= v <= 1 + 1e-12 for v in list(got.values()) + list(total.values()))


def test_trajectories_drop_empty_areas(panel):
    wide = trajectories.trajectory_table(panel.cells, "2000", OUT)
    got = {r.area_code: tuple(r)[1:] for r in wide.collect()}
    assert got["E1"] == tuple(2 * m for m in range(2, 9))
    assert got["W1"] == (0, 1, 0, 0, 0, 0, 0)
    only_minor = trajectories.trajectory_table(panel.cells, "1999", OUT)
    assert "W1" not in {r.area_code for r in only_minor.collect()}


def test_month_change_shares(panel, labels):
    season = change.season_counts(panel.cells, labels, ["2000"], OUT)
    assert season.count() == 2 * 7
    got = {(r.traj, r.step): r for r in change.month_change_share(season).collect()}
    assert got[("B", "feb_mar")].count_change == 1 and got[("B", "mar_apr")].count_change == -1
    assert got[("B", "apr_may")].count_change == 0
    for step in ("feb_mar", "mar_apr"):
        moved = sum(abs(got[(t, step)].share) for t in "AB")
        assert moved == pytest.approx(1)
    assert got[("A", "feb_mar")].count_change == (6 + 0) - (4 + 2)
    assert got[("B", "feb_mar")].prop_label == "100%"


def test_step_without_any_change_has_no_share(spark):
    cells = spark.createDataFrame([("x", "a", f"2000-0{m}", "2000", 3) for m in range(2, 9)], "area_code string, category string, month string, year string, n long")
    labels = spark.createDataFrame([("x", "A")], "area_code string, traj string")
    got = change.month_change_share(change.season_counts(cells, labels, ["2000"], ()))
    assert {(r.count_change, r.share, r.prop_label) for r in got.collect()} == {(0, None, None)}


def test_year_on_year_with_zero_base(panel, labels):
    season = change.season_counts(panel.cells, labels, ["1999", "2000"], OUT)
    got = {(r.traj, r.month): r for r in change.year_on_year(season, labels, "1999", "2000").collect()}
    assert got[("B", "03")].count_change == 1 and got[("B", "03")].percent_change is None
    assert got[("B", "04")].count_change == 0 and got[("B", "04")].percent_change is None
    assert got[("A", "06")].count_change == 6 and got[("A", "06")].percent_change == pytest.approx(100.0)
    assert got[("A", "05")].av_change == 2.5 and got[("A", "05")].n_areas == 2


def test_composition_sums_to_one_and_keeps_zero_shares(panel, labels):
    shares = composition.composition(panel, labels, "2000", OUT)
    got = {(r.category, r.traj, r.month): r.share for r in shares.collect()}
    assert got[("arson", "A", "2000-05")] == 0.0
    assert got[("fraud", "B", "2000-03")] == 1.0
    assert got[("fraud", "B", "2000-04")] is None
    sums = [r.total for r in composition.share_sums(shares).collect()]
    assert all(s is None or s == pytest.approx(1) for s in sums) and any(s for s in sums)


def test_cluster_lines_and_percentiles(panel, labels):
    freq = distribution.cluster_frequencies(panel, labels, OUT)
    got = {(r.traj, r.month): r for r in distribution.median_mean_lines(freq).collect()}
    assert (got[("A", "2000-04")].median, got[("A", "2000-04")].mean) == (4.5, 4.5)
    assert (got[("B", "2000-04")].median, got[("B", "2000-04")].month_name) == (0.0, "April")
    assert {(r.traj, r.month): r.centre for r in distribution.centres(freq).collect()}[("A", "1999-06")] == 3.0


def test_density_integrates_to_about_one(spark):
    rng = np.random.default_rng(1)
    values = rng.poisson(6, 500)
    freq = spark.createDataFrame([("A", "2000-02", "2000", int(v)) for v in values], "traj string, month string, year string, n long")
    freq = freq.groupBy("traj", "month", "year", "n").agg(F.count("*").alias("freq"))
    grid = distribution.density_grid(freq, "2000", points=200, adjust=1.0).orderBy("point").collect()
    sd, (q1, q3) = values.std(ddof=1), np.quantile(values, [0.25, 0.75])
    bw = 0.9 * min(sd, (q3 - q1) / 1.34) * len(values) ** -0.2
    want = [np.exp(-(((r["at"] - values) / bw) ** 2) / 2).sum() / (len(values) * bw * math.sqrt(2 * math.pi)) for r in grid]
    assert [r.density for r in grid] == pytest.approx(want)
    assert 0.9 < sum(want) * (grid[1]["at"] - grid[0]["at"]) < 1.05


def test_titles_follow_sizes(spark):
    labels = spark.createDataFrame([(f"a{i}", "A" if i < 1990 else "B") for i in range(2000)], "area_code string, traj string")
    assert rows(trajectories.cluster_sizes(labels), "traj", "traj_title") == [("A", "[A] N = 1,990 (100%)"), ("B", "[B] N = 10 (0.5%)")]


def test_missing_value_report(spark, incidents):
    got = {(r["check"], r.detail): r.value for r in quality.missing_values(incidents).collect()}
    assert got[("missing_area_code", "2000")] == 2 and got[("missing_area_and_x", "2000")] == 2
    assert got[("missing_category", "1999")] == 1 and got[("missing_month", "1999")] == 0
