"""The test tables in the roles of the analysis (see FIXTURES.md).

Every view is a projection of the given tables with plain arithmetic on their keys, so that it
grows with them and an SQL engine can compute the same values.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the fixture mapping.
EXCLUDED_PROVIDERS = ("NATION_3", "NATION_7")
EXCLUDED_LABELS = "NATION_3 |NATION_7 "
EXCLUDED_PREFIX = "9"
NON_NOTIFIABLE = ("4-NOT SPECIFIED", "5-LOW")
LONG_RUN_CATEGORIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")
CITIES = {
    "North": "NATION_2",
    "South": "NATION_24",
    "East": "NATION_5 ",
    "West": "NATION_6 ",
    "Upper": "NATION_8 ",
    "Lower": "NATION_9 ",
}
GRID_COLUMNS = 100
CELL_SIZE = 10
GRID_EAST, GRID_SCALE_X, GRID_SCALE_Y = 180000, 360, 1100
LETTER_RESIDUES = "AAAAAAAAABBBBBBCCCCDDDEEF"
POI_TAGS = (
    ("amenity", "pub"),
    ("amenity", "nightclub"),
    ("amenity", "restaurant"),
    ("shop", "clothes"),
    ("shop", "shoes"),
    ("shop", "mall"),
    ("shop", "department_store"),
    ("shop", "supermarket"),
    ("shop", "chemist"),
    ("shop", "cosmetics"),
    ("shop", "electrical"),
    ("shop", "greengrocer"),
    ("railway", "station"),
    ("highway", "bus_stop"),
    ("amenity", "bicycle_parking"),
    ("amenity", "parking_space"),
    ("amenity", "parking_entrance"),
    ("amenity", "motorcycle_parking"),
    ("shop", "convenience"),
    ("amenity", "bar"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def area_code(key: Column) -> Column:
    prefix = F.when(key % 10 < 7, "E").when(key % 10 < 9, "W").otherwise("9")
    return F.concat(prefix, F.lpad(key.cast("string"), 12, "0"))


def incidents(spark: SparkSession, sf_dir: str, *years: str) -> DataFrame:
    """One row per order, of the given years if any. Every eleventh key is reported by the neighbouring provider.

    Years are asked of the stored date, where the scan can skip row groups.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    if years:
        day = F.col("o_orderdate")
        spans = [(day >= F.lit(f"{y}-01-01").cast("timestamp_ntz")) & (day < F.lit(f"{int(y) + 1}-01-01").cast("timestamp_ntz")) for y in years]
        orders = orders.filter(reduce(or_, spans))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    shifted = F.when(F.col("o_orderkey") % 11 == 0, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("_reporter", shifted)
    located = F.col("o_orderkey") % 97 != 0
    period = F.substring(F.col("o_orderdate").cast("string"), 1, 7)
    key = F.col("o_custkey")
    return joined.join(nation, F.col("_reporter") == F.col("n_nationkey")).select(
        F.col("o_orderkey").alias("incident_id"),
        F.col("n_name").alias("reported_by"),
        period.alias("month"),
        F.substring(period, 1, 4).alias("year"),
        F.col("o_orderpriority").alias("category"),
        F.when(located, area_code(key)).alias("area_code"),
        F.when(located, (key * 37 % 500) / F.lit(10.0)).alias("x"),
        F.when(located, ((key * 91 + 50) % 500) / F.lit(10.0)).alias("y"),
    )


def _ring(points: list[tuple[float, float]]) -> Column:
    x0 = (F.col("c_custkey") % GRID_COLUMNS * CELL_SIZE).cast("double")
    y0 = (F.floor(F.col("c_custkey") / GRID_COLUMNS) * CELL_SIZE).cast("double")
    return F.array(*[F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y")) for dx, dy in points])


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
TRIANGLE = [(0, 0), (10, 0), (0, 10), (0, 0)]
HOLE = [(3, 3), (3, 7), (7, 7), (7, 3), (3, 3)]


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polygon per customer on a grid that grows upwards: squares, triangles, squares with a hole."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    kind = F.col("c_custkey") % 4
    shape = (
        F.when(kind == 1, F.array(_ring(TRIANGLE)))
        .when(kind == 2, F.array(_ring(SQUARE), _ring(HOLE)))
        .otherwise(F.array(_ring(SQUARE)))
    )
    names = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    # By its compressed size Spark may send out the larger side instead, and make all polygons in one task.
    return customer.join(F.broadcast(names), F.col("c_nationkey") == F.col("n_nationkey")).select(
        area_code(F.col("c_custkey")).alias("geo_code"),
        F.concat_ws(" ", "n_name", "r_name", F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("geo_label"),
        shape.alias("rings"),
    )


LEFT_STRIP = [(0, 0), (4, 0), (4, 10), (0, 10), (0, 0)]
RIGHT_STRIP = [(6, 0), (10, 0), (10, 10), (6, 10), (6, 0)]


def boundaries_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same areas, every fourth of two parts."""
    layer = table(spark, sf_dir, "customer").select(area_code(F.col("c_custkey")).alias("geo_code"), "c_custkey")
    rows = boundaries(spark, sf_dir).join(layer, "geo_code")
    two = F.col("c_custkey") % 4 == 3
    rings = F.when(two, F.array(_ring(LEFT_STRIP), _ring(RIGHT_STRIP))).otherwise(F.col("rings"))
    sizes = F.when(two, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.size("rings")))
    return rows.select("geo_code", "geo_label", rings.alias("rings"), sizes.alias("part_sizes"))


def metric_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same layer stretched to national grid metres."""
    move = lambda p: F.struct(
        (p["x"] * GRID_SCALE_X + GRID_EAST).alias("x"), (p["y"] * GRID_SCALE_Y).alias("y")
    )
    rings = F.transform("rings", lambda ring: F.transform(ring, move))
    return boundaries(spark, sf_dir).withColumn("rings", rings)


BAD_RINGS = {
    1: [SQUARE, [(1, 1), (9, 1), (9, 9), (1, 9), (1, 1)], [(3, 3), (6, 3), (6, 6), (3, 6), (3, 3)]],
    2: [SQUARE, [(0, 5), (5, 2), (10, 5), (5, 8), (0, 5)]],
    3: [SQUARE, [(2, 2), (5, 2), (3, 5), (5, 8), (2, 8), (2, 2)], [(5, 2), (8, 2), (8, 8), (5, 8), (7, 5), (5, 2)]],
    7: [SQUARE, [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]],
    9: [[(0, 0), (10, 0), (10, 10), (7, 5), (5, 4), (3, 5), (0, 10), (0, 0)], [(10, 10), (5, 4), (0, 10), (5, 9), (10, 10)]],
    13: [SQUARE, [(0, 5), (4, 7), (4, 3), (0, 5)]],
    15: [SQUARE, [(2, 2), (8, 2), (8, 8), (2, 8), (2, 2)], [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]],
    5: [[(0, 0), (10, 0), (10, 10), (0, 10)]],
    11: [[(0, 0), (10, 0), (0, 0)]],
    17: [[(0, 0), (10, 0), (10, 0), (10, 10), (0, 10), (0, 0)]],
    23: [[(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)]],
    29: [SQUARE, [(12, 3), (12, 7), (16, 7), (16, 3), (12, 3)]],
    31: [SQUARE, SQUARE],
    35: [SQUARE, [(0, 3), (0, 7), (4, 7), (4, 3), (0, 3)]],
    37: [SQUARE, [(3, 3), (3, 7), (7, 5), (3, 3)]],
}
SEVERAL_PARTS = {7: [1, 1], 15: [2, 1]}


def unchecked_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of which some are unclosed, too short, repeat a point or cross themselves, or have a hole outside
    the shell, a ring twice, a hole along an edge, a hole in a hole, holes that cut the interior, a part in a part; and good
    ones, a hole that touches once and a part in a hole among them."""
    customer = table(spark, sf_dir, "customer").select("c_custkey")
    kind = F.col("c_custkey") % 40
    shape = F.array(_ring(SQUARE))
    for residue, rings in BAD_RINGS.items():
        shape = F.when(kind == residue, F.array(*map(_ring, rings))).otherwise(shape)
    sizes = F.array(F.size("rings"))
    for residue, parts in SEVERAL_PARTS.items():
        sizes = F.when(F.col("_kind") == residue, F.array(*map(F.lit, parts))).otherwise(sizes)
    return customer.select(area_code(F.col("c_custkey")).alias("geo_code"), shape.alias("rings"), kind.alias("_kind")).select(
        "geo_code", "rings", sizes.alias("part_sizes")
    )


def points_of_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per event; two consecutive events share a place, and the layer grows upwards.

    Coordinates are multiples of 1/32, exact in binary, so points on an edge are on it in any engine.
    """
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    place = F.floor(F.col("event_id") / 2)
    listed = ", ".join(f"'{k}={v}'" for k, v in POI_TAGS)
    tag = F.split(F.element_at(F.expr(f"array({listed})"), (F.col("user_id") % len(POI_TAGS) + 1).cast("int")), "=")
    x, y = (place * 37 % 8000) / F.lit(8.0), place / F.lit(32.0)
    return events.select(
        F.col("event_id").alias("poi_id"),
        tag[0].alias("key"),
        tag[1].alias("value"),
        F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("poi "), F.col("event_id").cast("string"))).alias("name"),
        x.alias("x"),
        y.alias("y"),
        (F.lit(-5.0) + x / F.lit(200.0)).alias("lon"),
        (F.lit(50.0) + F.pmod(y, F.lit(800.0)) / F.lit(100.0)).alias("lat"),
    )


REF = "struct<kind:string,id:bigint,role:string>"
HUB = 7


def map_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points as nodes, of which a third have their tag themselves; every tenth point also gives a way over it, the next
    three and one node that all ways share, every hundredth a relation of a node, a way and a relation. Some ways are
    deleted, and the last ones name nodes that are missing."""
    points = points_of_interest(spark, sf_dir).withColumnRenamed("poi_id", "id")
    tag = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    listed = F.array(tag(F.col("key"), F.col("value")))
    named = lambda name: F.filter(F.array(tag(F.lit("name"), name)), lambda t: t["value"].isNotNull())
    ref = lambda kind, key, role: F.struct(F.lit(kind).alias("kind"), key.cast("long").alias("id"), F.lit(role).alias("role"))
    id_ = F.col("id")
    none = F.lit(None).cast("double")
    nodes = points.select(
        F.lit("n").alias("kind"), "id", F.lit(1).alias("version"), F.lit(True).alias("visible"),
        F.concat(F.when(id_ % 3 == 0, listed).otherwise(F.slice(listed, 1, 0)), named(F.col("name"))).alias("tags"),
        "lon", "lat", F.array().cast(f"array<{REF}>").alias("refs"),
    )
    shape = lambda rows, kind, visible, refs: rows.select(
        F.lit(kind).alias("kind"), "id", F.lit(1).alias("version"), visible.alias("visible"),
        F.concat(listed, named(F.lit("caf\u00e9, 100% = @home"))).alias("tags"), none.alias("lon"), none.alias("lat"), refs.cast(f"array<{REF}>").alias("refs"),
    )
    corners = F.array(*(ref("n", k, "") for k in (id_, id_ + 1, id_ + 2, id_ + 3, F.lit(HUB))))
    ways = shape(points.filter(id_ % 10 == 1), "w", id_ % 50 != 1, corners)
    members = F.array(ref("n", id_ + 1, "entrance"), ref("w", id_ + 6, "outer"), ref("r", id_ + 100, ""))
    return nodes.union(ways).union(shape(points.filter(id_ % 100 == 5), "r", F.lit(True), members))


def fixed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster letter per area from its key: sizes fall from A to F."""
    key = F.col("c_custkey")
    letter = F.substring(F.lit(LETTER_RESIDUES), (key % 25 + 1).cast("int"), F.lit(1))
    return table(spark, sf_dir, "customer").select(area_code(key).alias("area_code"), letter.alias("traj"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as incidents of their supplier: a dense panel for clustering."""
    period = F.substring(F.col("l_shipdate").cast("string"), 1, 7)
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.lpad(F.col("l_suppkey").cast("string"), 12, "0")).alias("area_code"),
        period.alias("month"),
        F.substring(period, 1, 4).alias("year"),
        F.col("l_returnflag").alias("category"),
    )


def shipment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    letter = F.substring(F.lit(LETTER_RESIDUES), (key % 25 + 1).cast("int"), F.lit(1))
    code = F.concat(F.lit("S"), F.lpad(key.cast("string"), 12, "0"))
    return table(spark, sf_dir, "supplier").select(code.alias("area_code"), letter.alias("traj"))
