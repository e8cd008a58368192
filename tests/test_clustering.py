import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallyward.operators import clustering
from tallyward.plans import trajectories
from tallyward.plans.settings import MONTH_NAMES
from tallyward.sources.staging import fresh_path

SIZES = (50, 30, 12, 5, 2, 1)


@pytest.fixture(scope="module")
def planted(spark):
    """Six well separated groups of 50 / 30 / 12 / 5 / 2 / 1 trajectories."""
    rng = np.random.default_rng(3)
    data = []
    for g, size in enumerate(SIZES):
        for i in range(size):
            level = 1000 * g * g + rng.integers(0, 20, len(MONTH_NAMES))
            data.append((f"g{g}-{i}", *[int(v) for v in level]))
    schema = "area_code string, " + ", ".join(f"{m} long" for m in MONTH_NAMES)
    return spark.createDataFrame(data, schema).persist()


def test_planted_clusters_are_found_and_lettered_by_size(planted):
    out = trajectories.trajectory_clusters(planted, 6, restarts=12).collect()
    assert len(out) == sum(SIZES)
    for r in out:
        assert r.traj == "ABCDEF"[int(r.area_code[1])]
    assert {r.traj_title for r in out if r.traj == "A"} == {"[A] N = 50 (50%)"}


def test_more_restarts_never_cost_more(planted):
    few = clustering.fit_restarts(planted, MONTH_NAMES, [5], restarts=1)[5].cost
    many = clustering.fit_restarts(planted, MONTH_NAMES, [5], restarts=4)[5].cost
    assert many <= few


def test_calinski_harabasz_prefers_the_planted_number(planted):
    scores = {r.candidate: r.ch for r in trajectories.score_candidates(planted, [3, 6], restarts=8).collect()}
    assert scores[6] > scores[3]


def test_calinski_harabasz_by_hand(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("b", 10.0), ("b", 12.0)], "c string, v double")
    got = clustering.calinski_harabasz(df, ["v"], "c").first()
    assert (got.within, got.between) == pytest.approx((4.0, 100.0))
    assert got.ch == pytest.approx((100 / 1) / (4 / 2))


def test_lloyd_step_moves_centres(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (10.0, 0.0)], "x double, y double")
    start = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 0.0), (3, 9.0, 0.0)], "cluster int, x double, y double")
    got = rows(clustering.lloyd_step(df, ["x", "y"], start))
    assert got == [(1, 2, 4.0, 1.0, 0.0), (2, 1, 1.0, 10.0, 0.0)]


def test_components_match_the_correlation_matrix(planted):
    data = np.array([[r[m] for m in MONTH_NAMES] for r in planted.collect()], dtype=float)
    values, vectors = np.linalg.eigh(np.corrcoef(data.T))
    got = clustering.principal_components(planted, "area_code", MONTH_NAMES)
    shares = [r.variance_share for r in got.variance.orderBy("component").collect()]
    assert shares == pytest.approx(sorted(values / values.sum(), reverse=True), abs=1e-9)
    first = vectors[:, -1] * np.sign(vectors[np.abs(vectors[:, -1]).argmax(), -1])
    z = (data - data.mean(0)) / data.std(0, ddof=1)
    by_code = {r.area_code: r.pc1 for r in got.scores.collect()}
    codes = [r.area_code for r in planted.collect()]
    assert [by_code[c] for c in codes] == pytest.approx(list(z @ first), abs=1e-9)


def test_correlation_matrix(planted):
    data = np.array([[r[m] for m in MONTH_NAMES] for r in planted.collect()], dtype=float)
    want = np.corrcoef(data.T)
    got = {(r.a, r.b): r["corr"] for r in clustering.correlation_matrix(planted, MONTH_NAMES).collect()}
    assert len(got) == 49
    assert got[("march", "july")] == pytest.approx(want[1, 5]) and got[("july", "march")] == got[("march", "july")]


def test_saved_centres_give_the_same_labels(spark, planted):
    centres = clustering.fit_restarts(planted, MONTH_NAMES, [6], restarts=2)[6].centres
    path = fresh_path(spark, "model")
    clustering.save_centres(spark, MONTH_NAMES, centres, path)
    loaded = clustering.load_centres(spark, MONTH_NAMES, path)
    assert (loaded == centres).all()
    assert clustering.assign(planted, MONTH_NAMES, loaded).select("cluster").distinct().count() == 6


def test_runs_end_where_no_centre_moves_and_do_not_depend_on_partitions(planted):
    one = clustering.fit_restarts(planted.coalesce(1), MONTH_NAMES, [4], restarts=3)[4]
    many = clustering.fit_restarts(planted.repartition(7), MONTH_NAMES, [4], restarts=3)[4]
    assert np.allclose(one.centres, many.centres) and one.steps == many.steps
    data = np.array([[r[m] for m in MONTH_NAMES] for r in planted.collect()], float)
    near = ((data[:, None] - one.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.allclose(one.centres, [data[near == c].mean(axis=0) for c in range(4)])


def test_settle_equals_plain_lloyd(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(200, 2))
    start = data[:5].copy()
    frame = spark.createDataFrame([tuple(map(float, r)) for r in data], "x double, y double")
    centres, cost, _ = clustering.settle(frame, {"a": start, "b": start[:2]})["a"]
    while True:
        near = ((data[:, None] - start[None]) ** 2).sum(axis=2).argmin(axis=1)
        after = np.array([data[near == c].mean(axis=0) for c in range(5)])
        if np.allclose(after, start, atol=1e-12):
            break
        start = after
    assert np.allclose(centres, start) and cost == pytest.approx(((data - start[near]) ** 2).sum())


def test_letters_go_on_after_z(spark):
    df = spark.range(710).select(F.col("id").cast("int").alias("cluster"))
    got = {r.cluster: r.traj for r in trajectories.letters_by_size(df).collect()}
    assert [got[i] for i in (0, 25, 26, 27, 52, 701, 702, 703)] == ["A", "Z", "AA", "AB", "BA", "ZZ", "AAA", "AAB"]


def test_letters_break_size_ties_by_id(spark):
    df = spark.createDataFrame([(5,), (3,), (7,), (7,)], "cluster int")
    assert rows(clustering_letters(df)) == [("3", "B"), ("5", "C"), ("7", "A")]


def clustering_letters(df):
    return trajectories.letters_by_size(df).select(F.col("cluster").cast("string"), "traj")


def test_equal_rows_are_one_row_of_many_tasks(spark, planted, monkeypatch):
    seen = []
    real = clustering.stage
    monkeypatch.setattr(clustering, "TASK_ROWS", 10, raising=False)
    monkeypatch.setattr(clustering, "stage", lambda df, label: seen.append(real(df, label)) or seen[-1])
    once = clustering.fit_restarts(planted, MONTH_NAMES, [4], restarts=2)[4]
    four = planted.union(planted).union(planted.union(planted)).coalesce(1)
    fit = clustering.fit_restarts(four, MONTH_NAMES, [4], restarts=2)[4]
    assert seen[-1].count() == planted.select(*MONTH_NAMES).distinct().count() < four.count()
    assert len(seen[-1].inputFiles()) > 1
    assert np.allclose(fit.centres, once.centres) and np.isclose(fit.cost, 4 * once.cost)
