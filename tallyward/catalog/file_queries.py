"""Round trips through files in a fresh shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyward.catalog.cluster_queries import K, wide_of
from tallyward.catalog.panel_queries import panel_of, write_drops
from tallyward.catalog.registry import register
from tallyward.catalog.spatial_queries import facilities_of
from tallyward.catalog.sql_views import BOUNDARIES, EXTRACT_POINTS, FACILITIES, INCIDENTS, PANEL, POI, using
from tallyward.operators.clustering import assign, fit_restarts, load_centres, save_centres
from tallyward.plans.settings import MONTH_NAMES
from tallyward.sources import extract, files, role_views as views, shapefile
from tallyward.sources.staging import fresh_path, stage


@register(
    using(INCIDENTS)
    + """ SELECT year, month, crime_type, count(*) AS n, count(lsoa_code) AS n_located, count(DISTINCT lsoa_code) AS n_areas
FROM (SELECT year, month, category AS crime_type, area_code AS lsoa_code FROM incidents) GROUP BY year, month, crime_type"""
)
def csv_glob_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly CSV drops below one folder, read back in one scan with the year taken from the path."""
    root = fresh_path(spark, "drops")
    write_drops(views.incidents(spark, sf_dir), root)
    back = files.read_csv_tree(spark, root, files.INCIDENT_FILE_SCHEMA, "*.csv", r"/drop=(\d{4})-\d{2}/")
    return back.groupBy("year", "month", "crime_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("lsoa_code").alias("n_located"), F.count_distinct("lsoa_code").alias("n_areas")
    )


@register(using(FACILITIES) + " SELECT * FROM facilities")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = facilities_of(spark, sf_dir)
    path = fresh_path(spark, "facilities")
    files.write_csv(table, path)
    return files.read_csv(spark, path, table.schema)


@register(
    using(PANEL) + " SELECT category, month, area_code, n FROM panel WHERE year = '2000'"
)
def panel_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel written by year; reading one year touches that folder only."""
    path = fresh_path(spark, "panel")
    files.write_panel(panel_of(spark, sf_dir).dense(), path)
    schema = "category string, month string, area_code string, n bigint, year string"
    return spark.read.schema(schema).parquet(path).filter(F.col("year") == "2000").drop("year")


# Every coordinate of the layer, by part, ring and point: squares, triangles, squares with a hole, and every third square
# as an area of two parts.
PARTS_SQL = """
, shape AS (
  SELECT geo_code, geo_label, x0, y0, kind, part, ring, UNNEST(CASE
    WHEN kind = 1 THEN [[0, 0], [10, 0], [0, 10], [0, 0]]
    WHEN ring = 1 THEN [[3, 3], [3, 7], [7, 7], [7, 3], [3, 3]]
    WHEN kind = 3 AND part = 0 THEN [[0, 0], [4, 0], [4, 10], [0, 10], [0, 0]]
    WHEN kind = 3 THEN [[6, 0], [10, 0], [10, 10], [6, 10], [6, 0]]
    ELSE [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]] END) AS p,
    generate_subscripts(CASE WHEN kind = 1 THEN [1, 2, 3, 4] ELSE [1, 2, 3, 4, 5] END, 1) - 1 AS point
  FROM boundaries, (VALUES (0, 0), (0, 1), (1, 0)) AS v(part, ring)
  WHERE (part = 0 AND ring = 0) OR (kind = 2 AND ring = 1) OR (kind = 3 AND part = 1)
)
SELECT geo_code, geo_label, CAST(part AS INTEGER) AS part, CAST(ring AS INTEGER) AS ring, CAST(point AS INTEGER) AS point,
       CAST(x0 + p[1] AS DOUBLE) AS x, CAST(y0 + p[2] AS DOUBLE) AS y FROM shape"""


@register(using(BOUNDARIES) + PARTS_SQL)
def boundary_geojson_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary layer, areas of two parts included, through newline-delimited GeoJSON; all coordinates."""
    path = fresh_path(spark, "boundaries")
    files.write_boundary_lines(views.boundaries_in_parts(spark, sf_dir), path)
    return _coordinates(files.read_boundary_lines(spark, path))


def _coordinates(layer: DataFrame) -> DataFrame:
    parts = layer.select("geo_code", "geo_label", F.posexplode(files.parts_of(F.col("rings"), F.col("part_sizes"))).alias("part", "rings"))
    rings = parts.select("geo_code", "geo_label", "part", F.posexplode("rings").alias("ring", "points"))
    points = rings.select("geo_code", "geo_label", "part", "ring", F.posexplode("points").alias("point", "p"))
    return points.select("geo_code", "geo_label", "part", "ring", "point", "p.x", "p.y")


@register(using(BOUNDARIES) + PARTS_SQL)
def boundary_shapefile_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary layer, areas of two parts included, written in two appends and read as shapefiles; all coordinates."""
    path = fresh_path(spark, "shapes")
    shapefile.register(spark)
    layer = views.boundaries_in_parts(spark, sf_dir)
    odd = F.crc32(F.col("geo_code").cast("binary")) % 2 == 1
    for some in (layer.filter(odd), layer.filter(~odd)):
        some.write.format("polygons").mode("append").save(path)
    return _coordinates(spark.read.format("polygons").load(path))


@register(using(BOUNDARIES) + " SELECT geo_code, geo_label, x0 AS minx, y0 + 10 AS maxy FROM (SELECT geo_code, geo_label, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0 FROM boundaries) WHERE x0 <= 300 AND x0 + 10 >= 100")
def boundary_shapefile_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas whose box meets a range of x, tested by the source in front of each shape."""
    path = fresh_path(spark, "shapes")
    shapefile.register(spark)
    views.boundaries_in_parts(spark, sf_dir).write.format("polygons").mode("append").save(path)
    found = spark.read.format("polygons").load(path).filter("minx <= 300 AND maxx >= 100")
    return found.select("geo_code", "geo_label", "minx", "maxy")


@register(using(BOUNDARIES) + " SELECT geo_code, geo_label, k AS traj FROM (SELECT *, kind % 3 AS k FROM boundaries) WHERE k <> 2")
def labelled_layer_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer with a label of each area, written as GeoJSON and as parquet; rows where both come back the same."""
    kind = F.expr("CAST(substr(geo_code, 2) AS BIGINT) % 4")
    layer = views.boundaries(spark, sf_dir).withColumn("traj", (kind % 3).cast("long")).filter("traj <> 2")
    lines, table = fresh_path(spark, "lines"), fresh_path(spark, "layer")
    files.write_boundary_lines(layer, lines)
    files.write_boundary_layer(layer, table)
    a = files.read_boundary_lines(spark, lines, properties={"traj": "traj"}).withColumnRenamed("rings", "other")
    b = spark.read.schema(layer.schema).parquet(table)
    same = a.join(b.drop("geo_label"), "geo_code").filter((a["traj"].cast("long") == b["traj"]) & (F.col("other") == F.col("rings")))
    return same.select("geo_code", "geo_label", b["traj"])


@register(
    using(INCIDENTS)
    + """
SELECT month, category, count(*) AS n, count(area_code) AS n_located FROM incidents GROUP BY month, category"""
)
def csv_header_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their columns in two orders, and with one column more, below one folder: bound by name."""
    rows = views.incidents(spark, sf_dir)
    root = fresh_path(spark, "orders")
    first = rows.filter(F.col("incident_id") % 2 == 0).select("month", "category", "area_code")
    second = rows.filter(F.col("incident_id") % 2 != 0).select("area_code", F.lit("x").alias("note"), "category", "month")
    files.write_csv(first, f"{root}/first")
    files.write_csv(second, f"{root}/second")
    back = files.read_csv_tree(spark, root, first.schema)
    return back.groupBy("month", "category").agg(F.count(F.lit(1)).alias("n"), F.count("area_code").alias("n_located"))


@register("SELECT true AS same_labels, true AS same_centres")
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted model saved and loaded: the labels before and after."""
    wide = stage(wide_of(spark, sf_dir), "wide")
    centres = fit_restarts(wide, MONTH_NAMES, [K], restarts=2)[K].centres
    path = fresh_path(spark, "model")
    save_centres(spark, MONTH_NAMES, centres, path)
    loaded = load_centres(spark, MONTH_NAMES, path)
    before = assign(wide, MONTH_NAMES, centres).select("area_code", "cluster")
    after = assign(wide, MONTH_NAMES, loaded).select("area_code", F.col("cluster").alias("again"))
    same = F.every(F.coalesce(F.col("cluster") == F.col("again"), F.lit(False)))
    return before.join(after, "area_code", "full").agg(same.alias("same_labels")).withColumn("same_centres", F.lit(bool((centres == loaded).all())))


def _extract_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "extract")
    extract.write_extract(views.map_extract(spark, sf_dir), path)
    return extract.read_extract(spark, path)


@register(using(POI, EXTRACT_POINTS) + """ SELECT poi_id, key, value, name, own,
  CAST(round(lon * 1e7) AS BIGINT) AS lon_e7, CAST(round(lat * 1e7) AS BIGINT) AS lat_e7 FROM extract_points""")
def extract_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point of the listed tags with the vertices of ways and relations, from an extract written as lines."""
    found = extract.tagged_points(_extract_of(spark, sf_dir), views.POI_TAGS)
    place = lambda c: F.round(F.col(c) * 1e7).cast("long").alias(f"{c}_e7")
    return found.select("poi_id", "key", "value", "name", "own", place("lon"), place("lat"))


@register(using(POI, EXTRACT_POINTS) + """ SELECT key, value, count(*) AS n_points, count(*) FILTER (WHERE own) AS n_nodes, count(name) AS n_named,
  count(DISTINCT (lon, lat)) AS n_places FROM extract_points GROUP BY key, value""")
def extract_points_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each tag with and without vertices, those with a name, and their distinct places."""
    found = extract.tagged_points(_extract_of(spark, sf_dir), views.POI_TAGS)
    at = found.groupBy("key", "value", "lon", "lat").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("own"), F.count("name").alias("named"))
    return at.groupBy("key", "value").agg(
        F.sum("n").alias("n_points"), F.sum("own").alias("n_nodes"), F.sum("named").alias("n_named"), F.count(F.lit(1)).alias("n_places")
    )
