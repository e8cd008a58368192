"""Map extracts: lines, versions, and points with the vertices of shapes."""

from pyspark.sql import functions as F

from tallyward.sources.extract import latest, read_extract, tagged_points, write_extract
from tests.conftest import rows

LINES = [
    "n1 v1 dV c1 t2020-01-01T00:00:00Z i1 uAda%20%L Tamenity=pub,name=The%20%Caf%e9%%2c%%20%%1f37a% x-1.5 y52.25",
    "n2 v1 dV x0.1 y50",
    "n3 v1 dV Tname=Door x0.2 y50",
    "n4 v1 dD Tamenity=pub x0.3 y50",
    "n5 v1 dV Tshop=shoes,amenity=pub,shop=shoes x0.4 y50",
    "n6 v1 dV Tamenity=pub x y",
    "n7 v1 dV T x0.5 y51",
    "n8 v1 dV x0.6 y51",
    "w10 v1 dV Tamenity=pub,name=Inn Nn1,n2x0.1y50,n3,n2,n99",
    "w11 v1 dV T Nn7,n8,n2",
    "w12 v1 dD Tamenity=pub Nn8",
    "w13 v1 dV Tamenity=pub N",
    "r20 v1 dV Tamenity=pub Mn3@door,w11@outer%20%x,r21@,w404@",
    "r21 v1 dV Tshop=shoes,=odd,empty Mn8@",
    "c5 k0 s",
    "",
    "nonsense",
]


def elements(spark, tmp_path, lines=LINES):
    path = str(tmp_path / "lines")
    spark.createDataFrame([(v,) for v in lines], "value string").write.text(path)
    return read_extract(spark, path)


def test_lines(spark, tmp_path):
    read = {(r.kind, r.id): r for r in elements(spark, tmp_path).collect()}
    assert sorted(read) == [("n", i) for i in range(1, 9)] + [("r", 20), ("r", 21)] + [("w", i) for i in range(10, 14)]
    first = read["n", 1]
    assert [tuple(t) for t in first.tags] == [("amenity", "pub"), ("name", "The Café, \U0001f37a")]
    assert (first.lon, first.lat, first.version, first.visible) == (-1.5, 52.25, 1, True)
    assert not read["n", 4].visible and read["n", 6].lon is None
    assert [r.id for r in read["w", 10].refs] == [1, 2, 3, 2, 99] and read["w", 13].refs == []
    assert [tuple(r) for r in read["r", 20].refs] == [("n", 3, "door"), ("w", 11, "outer x"), ("r", 21, ""), ("w", 404, "")]
    assert [tuple(t) for t in read["r", 21].tags] == [("shop", "shoes"), ("", "odd"), ("empty", "")]


def test_escapes_that_are_no_code_points(spark, tmp_path):
    lines = ["n1 Tname=a%zz%b%d800%c%110000%d x1 y1", "n2 Tname=%41% x1 y1", "n3 Tname=a%20 x1 y1"]
    read = {r.id: r.tags[0].value for r in elements(spark, tmp_path, lines).collect()}
    assert read == {1: "abcd", 2: "A", 3: "a "}


def test_points_with_and_without_vertices(spark, tmp_path):
    found = elements(spark, tmp_path)
    pub = [("amenity", "pub")]
    assert rows(tagged_points(found, pub, vertices=False), "poi_id", "own") == [(1, True), (5, True)]
    got = rows(tagged_points(found, pub), "poi_id", "own", "name")
    # Of way 10: 1, 2, 3; of the relation: 3 and, through way 11, 7, 8 and 2. Deleted way 12 gives nothing.
    assert got == [(1, True, "The Café, \U0001f37a"), (2, False, None), (3, False, "Door"), (5, True, None), (7, False, None), (8, False, None)]
    shoes = rows(tagged_points(found, [("shop", "shoes"), *pub]).filter("key = 'shop'"), "poi_id", "own")
    assert shoes == [(5, True), (8, False)]
    assert tagged_points(found, [("shop", "none")]).count() == 0
    assert tagged_points(found.limit(0), pub).count() == 0


def test_latest_versions(spark, tmp_path):
    lines = ["n1 v1 dV Tamenity=pub x1 y1", "n1 v2 dV Tamenity=bar x1 y1", "n2 v1 dV Tamenity=pub x1 y1", "n2 v10 dD", "n3 v9 dV Tamenity=pub x1 y1", "n3 v9 dV Tamenity=pub x1 y1"]
    found = latest(elements(spark, tmp_path, lines))
    assert rows(found, "id", "version") == [(1, 2), (3, 9)]
    assert rows(tagged_points(found, [("amenity", "pub")]), "poi_id") == [(3,)]


def test_round_trip(spark, tmp_path):
    read = latest(elements(spark, tmp_path))
    path = str(tmp_path / "again")
    write_extract(read, path)
    plain = lambda df: sorted(df.select(F.to_json(F.struct(*df.columns))).collect())
    assert plain(read_extract(spark, path)) == plain(read)


def test_node_of_many_shapes_meets_one_row_a_tag(spark, tmp_path):
    lines = ["n1 x1 y1"] + [f"w{i} Tamenity=pub Nn1,n{i}" for i in range(10, 500)]
    found = tagged_points(elements(spark, tmp_path, lines), [("amenity", "pub")])
    assert rows(found, "poi_id") == [(1,)]
