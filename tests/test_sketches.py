"""Merged sketches against exact distinct counts."""

from conftest import rows
from pyspark.sql import functions as F

from tallyward.plans.panel import CountPanel
from tallyward.plans.sketches import BOUND, area_sketches, estimate, load_area_sketches, merge_distinct, save_area_sketches, sketch_distinct

SHAPE = "category string, month string, area_code string, year string, n long"


def panel_of(spark, cells):
    frame = spark.createDataFrame(cells, SHAPE)
    return CountPanel(frame, frame.select("year", "category", "month").distinct())


def test_few_values_are_exact_and_null_is_none(spark):
    cells = [("a", "2020-01", "E1", "2020", 3), ("b", "2020-01", "E1", "2020", 1), ("a", "2020-02", "W2", "2020", 1)]
    cells += [("a", "2020-02", "E3", "2020", 1), ("a", "2020-02", None, "2020", 1), ("a", None, "E9", None, 1)]
    made = area_sketches(panel_of(spark, cells))
    assert rows(estimate(made, ["year"])) == [(None, 1), ("2020", 3)]
    by_month = [(None, "E", 1), ("2020-01", "E", 1), ("2020-02", None, 0), ("2020-02", "E", 1), ("2020-02", "W", 1)]
    assert rows(estimate(made, ["month", "prefix"])) == by_month


def test_empty_tables(spark):
    assert rows(estimate(area_sketches(panel_of(spark, [])), ["year"])) == []


def test_many_values_stay_within_the_bound(spark):
    """A hot group of 200,000 values in months that overlap by half; merging repeated sketches changes nothing."""
    n = 200_000
    first = spark.range(n).select(F.lit("x").alias("g"), F.lit("01").alias("month"), F.concat(F.lit("E"), "id").alias("area_code"))
    second = spark.range(n // 2, 3 * n // 2).select(F.lit("x").alias("g"), F.lit("02").alias("month"), F.concat(F.lit("E"), "id").alias("area_code"))
    made = sketch_distinct(first.unionByName(second), ["g", "month"], "area_code")
    ((_, found),) = rows(estimate(made, ["g"]))
    assert abs(found - 3 * n // 2) <= BOUND * 3 * n // 2
    twice = merge_distinct(made, ["g"]).unionByName(merge_distinct(made.unionByName(made), ["g"]))
    assert rows(estimate(twice, ["g"])) == [("x", found)]
    assert max(len(r.sketch) for r in made.collect()) < 20_000


def test_saved_sketches_answer_for_months_without_the_cells(spark, tmp_path):
    cells = [("a", f"2020-0{m}", f"E{i}", "2020", 1) for m in (1, 2, 3) for i in range(m * 10)]
    path = str(tmp_path / "panel")
    save_area_sketches(panel_of(spark, cells), path)  # there are no cells below this folder
    assert rows(estimate(load_area_sketches(spark, path, ["2020-01", "2020-02"]), ["year"])) == [("2020", 20)]
    assert rows(estimate(load_area_sketches(spark, path), ["prefix"])) == [("E", 30)]
