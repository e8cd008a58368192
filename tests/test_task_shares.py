"""What one task holds: staged files, the layer, pairs of areas and facilities, segments of a cell."""

from pyspark.sql import functions as F

from tallyward.operators import ring_nesting, spatial
from tallyward.plans import facilities as plans
from tallyward.sources import role_views as views, staging

from conftest import rows

SQUARE = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0))]
RINGS = "rings array<array<struct<x:double,y:double>>>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_staged_task_writes_several_files(spark, monkeypatch):
    monkeypatch.setattr(staging, "FILE_ROWS", 10)
    back = staging.stage(spark.range(95).coalesce(1), "parts")
    assert len(back.inputFiles()) == 10 and back.count() == 95


def test_layer_is_made_by_the_tasks_that_scan_it(spark, tmp_path):
    customer = spark.range(40).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).alias("c_nationkey"))
    customer.repartition(4).write.parquet(f"{tmp_path}/customer.parquet")
    nation = spark.range(25).select(F.col("id").alias("n_nationkey"), F.concat(F.lit("N"), "id").alias("n_name"), (F.col("id") % 5).alias("n_regionkey"))
    nation.coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    region = spark.range(5).select(F.col("id").alias("r_regionkey"), F.lit("R" * 4000).alias("r_name"))
    region.coalesce(1).write.parquet(f"{tmp_path}/region.parquet")
    layer = views.boundaries(spark, str(tmp_path))
    assert layer.count() == 40
    assert layer.rdd.getNumPartitions() == 4


def test_pairs_of_areas_and_facilities_are_made_after_grouping(spark):
    tags = [plans.Tag("pubs", "amenity", "pub"), plans.Tag("bus", "highway", "bus_stop")]
    layer = spark.createDataFrame([("a", [SQUARE]), ("a", [SQUARE]), ("b", [SQUARE]), (None, [SQUARE])], f"geo_code string, {RINGS}")
    counts = spark.createDataFrame([("a", "pubs", 2), ("a", "pubs", 3), (None, "bus", 1), ("z", "bus", 4), ("b", "other", 5)], "geo_code string, facility string, n long")
    found = plans.zero_filled_facilities(counts, layer, tags)
    assert rows(found, "geo_code", "facility", "n") == [
        (None, "bus", 1), (None, "pubs", 0), ("a", "bus", 0), ("a", "pubs", 5), ("b", "bus", 0), ("b", "other", 5), ("b", "pubs", 0), ("z", "bus", 4)
    ]
    text = plan(found)
    assert text.index("Generate") < text.index("Aggregate")


def test_segments_are_not_sent_whole_to_every_task(spark, monkeypatch):
    layer = spark.createDataFrame([(f"E{i}", [SQUARE]) for i in range(30)], f"geo_code string, {RINGS}").coalesce(1)
    monkeypatch.setattr(spatial._dealt, "__defaults__", (20,), raising=False)
    contacts = spatial.ring_contacts(layer)
    assert "BroadcastHashJoin" not in plan(contacts)
    assert "REPARTITION_BY_NUM" in plan(contacts)
    assert [r.valid for r in ring_nesting.ring_validity(layer).collect()] == [True] * 30


def test_cover_is_not_sent_whole_to_every_task(spark):
    layer = spark.createDataFrame([("E1", [SQUARE])], f"geo_code string, {RINGS}")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 1.0)], "poi long, x double, y double")
    found = spatial.match_points(points, layer)
    assert rows(found, "geo_code", "poi") == [("E1", 1)]
    assert "SortMergeJoin" in plan(found)
