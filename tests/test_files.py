import json
import os

import pytest
from pyspark.sql import functions as F, types as T

from conftest import rows
from tallyward.sources import files, staging

HEADER = "Crime ID,Month,Reported by,Falls within,Longitude,Latitude,Location,LSOA code,LSOA name,Crime type,Last outcome category,Context"


@pytest.fixture
def drops(tmp_path):
    for name, month, area in [
        ("2019-12/2019-12-north-street.csv", "2019-12", "E1"),
        ("2020-01/2020-01-north-street.csv", "2020-01", "E2"),
        ("2020-01/2020-01-north-outcomes.csv", "2020-01", "E3"),
        ("2018-05/2018-05-south-street.csv", "2018-05", ""),
    ]:
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(f"{HEADER}\nid,{month},North,North,-1.5,52.5,On,{area},n,Drugs,,\n")
    return str(tmp_path)


def test_reads_street_files_of_the_wanted_years(spark, drops):
    df = files.read_incident_years(spark, drops, ["2019", "2020"])
    assert rows(df, "year", "month", "lsoa_code", "longitude") == [("2019", "2019-12", "E1", -1.5), ("2020", "2020-01", "E2", -1.5)]
    assert {"reported_by", "crime_type", "last_outcome_category"} <= set(df.columns)


def test_empty_area_is_null(spark, drops):
    df = files.read_incident_years(spark, drops, ["2018"])
    assert rows(df, "year", "lsoa_code") == [("2018", None)]


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "n int, k string")
    b = spark.createDataFrame([("y", 2, 3.0)], "k string, n int, extra double")
    assert rows(files.union_all([a, b]), "n", "k", "extra") == [(1, "x", None), (2, "y", 3.0)]


def test_csv_and_panel_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "2019", 1), ("b", "2020", None)], "k string, year string, n long")
    files.write_csv(df, str(tmp_path / "csv"))
    assert rows(files.read_csv(spark, str(tmp_path / "csv"), df.schema)) == rows(df)
    files.write_panel(df, str(tmp_path / "panel"))
    assert sorted(d for d in os.listdir(tmp_path / "panel") if d.startswith("year=")) == ["year=2019", "year=2020"]


def test_geojson_layer(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 0]]]
    hole = [[[1, 1], [2, 1], [2, 2], [1, 1]]]
    features = [
        {"type": "Feature", "properties": {"geo_code": "a", "geo_label": "A", "rank": 3}, "geometry": {"type": "Polygon", "coordinates": square + hole}},
        {"type": "Feature", "properties": {"geo_code": "b", "geo_label": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, hole]}},
        {"type": "Feature", "properties": {"geo_code": "c", "geo_label": "C"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    path = tmp_path / "layer.json"
    path.write_text("\n".join(json.dumps(f) for f in features))
    got = files.read_boundary_lines(spark, str(path)).select("geo_code", F.size("rings").alias("n"), F.col("rings")[1][0]["x"].alias("x"))
    assert rows(got) == [("a", 2, 1.0), ("b", 2, 1.0), ("c", None, None)]


def test_parts_survive_a_round_trip(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 0]]]
    hole = [[1, 1], [2, 1], [2, 2], [1, 1]]
    geometry = {"type": "MultiPolygon", "coordinates": [[*square, hole], [[[9, 9], [10, 9], [9, 10], [9, 9]]]]}
    lines = [{"type": "Feature", "properties": {"geo_code": "a", "geo_label": "A"}, "geometry": geometry}]
    lines += [{"type": "Feature", "properties": {"geo_code": "p"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]
    path = tmp_path / "layer.json"
    path.write_text("\n".join([*map(json.dumps, lines), "not json"]))
    layer = files.read_boundary_lines(spark, str(path)).filter("geo_code = 'a'")
    assert layer.first().part_sizes == [2, 1]
    files.write_boundary_lines(layer, str(tmp_path / "out"))
    back = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert back["geometry"] == geometry
    assert rows(files.boundary_faults(spark, str(path))) == [("Point", 1), ("unreadable", 1)]


def test_csv_columns_are_bound_by_name(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b\n1,x\n")
    (tmp_path / "two.csv").write_text('"b",c,a\ny,?,2\n')
    (tmp_path / "three.csv").write_text("b\nz\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    assert rows(files.read_csv_tree(spark, str(tmp_path), schema)) == [(None, "z"), (1, "x"), (2, "y")]
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "two.csv"), schema).collect()


def test_labelled_layer_as_parquet(spark, tmp_path):
    rings = [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]]
    df = spark.createDataFrame([("a", "[A] x", rings)], f"area_code string, traj_title string, rings {files.RING_TYPE}")
    files.write_boundary_layer(df, str(tmp_path / "layer"))
    assert spark.read.parquet(str(tmp_path / "layer")).first().rings[0][1].x == 1.0


def test_point_layer(spark, tmp_path):
    features = [
        {"type": "Feature", "id": "n1", "properties": {"amenity": "pub", "name": "Inn"}, "geometry": {"type": "Point", "coordinates": [-1.5, 52.5]}},
        {"type": "Feature", "id": "n2", "properties": {"shop": "shoes", "amenity": "bar", "colour": "red"}, "geometry": {"type": "Point", "coordinates": [1, 50]}},
        {"type": "Feature", "id": "w3", "properties": {"amenity": "pub"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 1], [0, 0]]]}},
    ]
    path = tmp_path / "points.json"
    path.write_text("\n".join(json.dumps(f) for f in features))
    assert rows(files.read_point_lines(spark, str(path)), "poi_id", "key", "value", "name", "lon", "lat") == [
        ("n1", "amenity", "pub", "Inn", -1.5, 52.5),
        ("n2", "amenity", "bar", None, 1.0, 50.0),
        ("n2", "shop", "shoes", None, 1.0, 50.0),
    ]


def test_stage_writes_below_the_shared_folder(spark):
    df = staging.stage(spark.createDataFrame([(1,), (None,)], "n int"), "t")
    assert rows(df) == [(None,), (1,)]
    assert all(f"{staging.shared_folder(spark)}/tallyward/t-" in f for f in df.inputFiles())


class Session:
    """Stands in for a session with the given master and no checkpoint folder."""

    def __init__(self, master):
        self.master, self.folder = master, None
        self.conf, self.sparkContext = self, self

    def get(self, name, default):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_a_cluster_must_name_the_folder():
    with pytest.raises(ValueError):
        staging.shared_folder(Session("yarn"))


def test_local_mode_sets_a_folder_once():
    session = Session("local[2]")
    assert staging.shared_folder(session) == staging.shared_folder(session) == session.folder
