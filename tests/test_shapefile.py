"""Shapefiles: exact round trips, the published byte layout, pruning, commits, and holes in any order."""

import datetime
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from tallyward.sources import shapefile
from tallyward.sources.shapefile import PolygonReader, PolygonSource, decode, encode, fields_of, grouped, stems

SHAPE = (
    "code string, label string, n long, area double, open boolean, day date, "
    "rings array<array<struct<x: double, y: double>>>, part_sizes array<int>"
)


def box(x, y, w, hole=False):
    ring = [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    return [(float(a), float(b)) for a, b in (ring[::-1] if hole else ring)]


ROWS = [
    ("a1", "Ärea One", 5, 0.1, True, datetime.date(2020, 2, 29), [box(0, 0, 10), box(2, 2, 3, True)], [2]),
    ("a2", None, None, -1e-300, False, None, [box(20, 0, 10), box(40, 0, 5), box(41, 1, 1, True)], [1, 2]),
    ("a3", "x" * 254, -(2**63), 1.7976931348623157e308, None, datetime.date(1999, 12, 31), [box(100, 0, 1 / 3)], [1]),
    ("a4", "no shape", 2**63 - 1, None, None, None, None, None),
]


@pytest.fixture
def layer(spark):
    shapefile.register(spark)
    return spark.createDataFrame(ROWS, SHAPE)


def read(spark, path, *conditions):
    found = spark.read.format("polygons").load(path)
    for c in conditions:
        found = found.filter(c)
    return {r.code: r for r in found.collect()}


def plain(rings):
    return [[(p.x, p.y) for p in r] for r in rings]


def test_round_trip(spark, layer, tmp_path):
    path = f"file://{tmp_path}/shapes"
    layer.repartition(2).write.format("polygons").mode("append").save(path)
    got = read(spark, path)
    for code, label, n, area, open_, day, rings, sizes in ROWS:
        r = got[code]
        assert (r.label, r.n, r.area, r.open, r.day) == (label, n, area, open_, day)
        assert plain(r.rings) == (rings or []) and r.part_sizes == (sizes or [])
    assert (got["a2"].minx, got["a2"].miny, got["a2"].maxx, got["a2"].maxy) == (20, 0, 45, 10) and got["a4"].minx is None
    assert set(read(spark, path, "minx < 30", "maxx >= 15")) == {"a2"}
    assert set(read(spark, path, "code IN ('a1', 'a4')", "n > 0")) == {"a1", "a4"}
    assert set(read(spark, path, "label = 'Ärea One'")) == {"a1"}


def test_byte_layout(spark, layer, tmp_path):
    layer.limit(1).write.format("polygons").mode("append").save(str(tmp_path / "s"))
    (stem,) = stems(str(tmp_path / "s"))
    shp, shx, dbf = (open(f"{stem}.{s}", "rb").read() for s in ("shp", "shx", "dbf"))
    assert struct.unpack(">i", shp[:4]) == (9994,) and struct.unpack(">i", shp[24:28])[0] * 2 == len(shp)
    assert struct.unpack("<ii", shp[28:36]) == (1000, 5) and struct.unpack("<4d", shp[36:68]) == (0, 0, 10, 10)
    assert struct.unpack(">ii", shx[100:108]) == (50, (len(shp) - 108) // 2) and len(shx) == 108
    assert struct.unpack(">ii", shp[100:108]) == (1, (len(shp) - 108) // 2)
    points = np.frombuffer(shp, "<f8", offset=108 + 44 + 8).reshape(-1, 2)
    assert shapefile.signed_area(points[:5]) < 0 < shapefile.signed_area(points[5:])  # shell clockwise, hole not
    n, head, width = struct.unpack("<IHH", dbf[4:12])
    assert n == 1 and len(dbf) == head + width + 1 and dbf[head - 1] == 0x0D and dbf[-1] == 0x1A


def test_filters_spare_the_points(spark, layer, tmp_path, monkeypatch):
    monkeypatch.setattr(shapefile, "PART_RECORDS", 2)
    path = str(tmp_path / "s")
    layer.coalesce(1).write.format("polygons").mode("append").save(path)
    schema = PolygonSource({"path": path}).schema()

    class Counting(PolygonReader):
        seen = 0

        def shape(self, content):
            Counting.seen += 1
            return super().shape(content)

    def codes(*filters):
        Counting.seen = 0
        reader = Counting(path, schema)
        assert list(reader.pushFilters(list(filters))) == []
        assert len(reader.partitions()) == 2
        return sorted(c for p in reader.partitions() for b in reader.read(p) for c in b.column("code").to_pylist()), Counting.seen

    assert codes() == (["a1", "a2", "a3", "a4"], 4)
    assert codes(GreaterThanOrEqual(("maxx",), 15.0), LessThan(("minx",), 30.0)) == (["a2"], 1)
    assert codes(In(("code",), ("a3", "zz"))) == (["a3"], 1)
    assert codes(EqualTo(("n",), 5), LessThan(("minx",), -1.0)) == ([], 0)
    kept = list(PolygonReader(path, schema).pushFilters([EqualTo(("rings",), 1), LessThan(("n",), 3)]))
    assert len(kept) == 2


def test_appends_overwrites_and_lost_attempts(spark, layer, tmp_path):
    path = str(tmp_path / "s")
    write = lambda rows, mode: rows.write.format("polygons").mode(mode).save(path)
    write(layer.filter("code = 'a1'"), "append")
    write(layer.filter("code = 'a2'"), "append")
    assert set(read(spark, path)) == {"a1", "a2"}
    lost = PolygonSource({"path": path}).writer(layer.schema, False)
    batch = layer.filter("code = 'a3'").toArrow().to_batches()
    lost.write(iter(batch))  # a task of a job that never commits
    assert set(read(spark, path)) == {"a1", "a2"}
    write(layer.filter("code = 'a4'"), "overwrite")
    assert set(read(spark, path)) == {"a4"}
    write(layer.filter("code = 'a1'"), "append")
    assert set(read(spark, path)) == {"a1", "a4"}
    write(layer.filter("code = 'none'"), "overwrite")
    with pytest.raises(Exception, match="no shapefile"):
        read(spark, path)


def test_holes_in_any_order():
    ring = lambda *a, hole=False: np.array(box(*a, hole=not hole))  # clockwise shells
    first, second, inner = ring(0, 0, 10), ring(20, 0, 10), ring(4, 4, 2)
    a, b, c = ring(3, 3, 4, hole=True), ring(22, 2, 1, hole=True), ring(60, 0, 1, hole=True)
    got = grouped([first, b, second, a, inner, c])
    assert [[id(r) for r in part] for part in got] == [[id(first), id(a)], [id(second), id(b)], [id(inner), id(c)]]
    assert decode(encode(None, None)[0]) == []


def test_what_the_format_cannot_hold(spark):
    with pytest.raises(ValueError, match="no place"):
        fields_of(spark.createDataFrame([], "a_very_long_name string").schema)
    with pytest.raises(ValueError, match="no place"):
        fields_of(spark.createDataFrame([], "m map<string, int>").schema)
    (field,) = fields_of(spark.createDataFrame([], "s string").schema)
    with pytest.raises(ValueError, match="do not fit"):
        field.text("é" * 128)


def test_a_set_of_files_ends_by_the_bytes_of_attributes_too(tmp_path, monkeypatch):
    monkeypatch.setattr(shapefile, "ROLL_BYTES", 2_000)
    monkeypatch.setattr(shapefile, "WRITE_ROWS", 7, raising=False)
    ring = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0))]
    batch = pa.RecordBatch.from_pylist([{"geo_code": f"E{i}", "label": "x" * 200, "rings": [ring], "part_sizes": [1]} for i in range(20)])
    schema = T.StructType([T.StructField("geo_code", T.StringType()), T.StructField("label", T.StringType()), *shapefile.GEOMETRY[:2]])
    writer = shapefile.PolygonWriter(str(tmp_path), schema, False)
    written = writer.write(iter([batch]))
    assert len(written.names) >= 5
    writer.commit([written])
    reader = shapefile.PolygonReader(str(tmp_path), T.StructType(schema.fields + shapefile.GEOMETRY[2:]))
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["geo_code"] for r in found) == sorted(f"E{i}" for i in range(20))
    assert all(r["rings"] == [ring] and (r["minx"], r["maxy"]) == (0.0, 1.0) for r in found)
