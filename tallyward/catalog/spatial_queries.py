"""Boundary, point-of-interest and facility queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyward.catalog.registry import register
from tallyward.catalog.sql_views import BOUNDARIES, COVERED, FACILITIES, FACILITY_COLUMNS, FIXED_LABELS, POI, SPATIAL, area, using
from tallyward.functions.national_grid import project, unproject
from tallyward.operators import ring_nesting, spatial
from tallyward.operators.reshape import widen
from tallyward.operators.rows import top_per_group
from tallyward.plans import facilities as plans
from tallyward.plans.reconcile import analysed_boundaries
from tallyward.sources import role_views as views
from tallyward.sources.staging import stage


def layer_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysed_boundaries(views.boundaries(spark, sf_dir), views.EXCLUDED_LABELS)


def facilities_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.facility_table(views.points_of_interest(spark, sf_dir), layer_of(spark, sf_dir))


@register(
    using(BOUNDARIES)
    + """ SELECT geo_code, geo_label FROM boundaries
WHERE left(geo_code, 1) IN ('E', 'W') AND NOT regexp_matches(geo_label, 'NATION_3 |NATION_7 ')"""
)
def regex_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer_of(spark, sf_dir).select("geo_code", "geo_label")


@register(
    using(BOUNDARIES)
    + """
SELECT min(x0) AS minx, min(y0) AS miny, max(x0) + 10 AS maxx, max(y0) + 10 AS maxy FROM boundaries
WHERE left(geo_code, 1) IN ('E', 'W') AND NOT regexp_matches(geo_label, 'NATION_3 |NATION_7 ')"""
)
def layer_bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.layer_box(layer_of(spark, sf_dir))


@register(
    using(SPATIAL)
    + """
SELECT poi_id, key, value, x, y FROM poi, (SELECT min(x0) AS a, min(y0) AS b, max(x0) + 10 AS c, max(y0) + 10 AS d FROM layer)
WHERE key = 'amenity' AND value = 'pub' AND x BETWEEN a AND c AND y BETWEEN b AND d"""
)
def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pubs = views.points_of_interest(spark, sf_dir).filter((F.col("key") == "amenity") & (F.col("value") == "pub"))
    return spatial.within_box(pubs, spatial.profile_layer(layer_of(spark, sf_dir))).select("poi_id", "key", "value", "x", "y")


@register(using(POI) + " SELECT DISTINCT key, value, x, y FROM poi")
def dedupe_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.distinct_points(views.points_of_interest(spark, sf_dir))


@register(using(SPATIAL) + " SELECT geo_code, facility, n FROM counts")
def poi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = layer_of(spark, sf_dir)
    counts = plans.facility_counts(views.points_of_interest(spark, sf_dir), layer)
    return plans.zero_filled_facilities(counts, layer)


@register(using(FACILITIES) + " SELECT * FROM facilities")
def facility_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facilities_of(spark, sf_dir)


@register(using(FACILITIES) + f" SELECT geo_code, {', '.join(FACILITY_COLUMNS)} FROM facilities")
def poi_counts_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long counts turned into one column per facility."""
    return widen(poi_counts(spark, sf_dir), ["geo_code"], "facility", "n", {c: c for c in FACILITY_COLUMNS})


@register(
    using(BOUNDARIES, POI)
    + f" SELECT b.geo_code, p.poi_id, p.name, p.value FROM boundaries b JOIN poi p ON {COVERED}"
)
def poi_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.points_of_interest(spark, sf_dir).select("poi_id", "name", "value", "x", "y")
    matched = spatial.match_points(points, stage(views.boundaries(spark, sf_dir), "layer"))
    return matched.select("geo_code", "poi_id", "name", "value")


@register(
    """
SELECT a.c_custkey AS area, b.c_custkey AS place FROM customer a JOIN customer b
ON b.c_custkey % 40 - a.c_custkey % 40 IN (0, 1)
AND (b.c_custkey - b.c_custkey % 40) // 40 - (a.c_custkey - a.c_custkey % 40) // 40 IN (0, 1)"""
)
def poi_border_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of side 0.1 with a point on every corner: borders that are not exact in binary, on a grid of that size."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    i, j = F.col("c_custkey") % 40, F.floor(F.col("c_custkey") / 40)
    at = lambda x, y: F.struct((x * F.lit(0.1)).alias("x"), (y * F.lit(0.1)).alias("y"))
    ring = F.array(at(i, j), at(i + 1, j), at(i + 1, j + 1), at(i, j + 1), at(i, j))
    squares = customer.select(F.col("c_custkey").alias("area"), F.array(ring).alias("rings"))
    points = customer.select(F.col("c_custkey").alias("place"), (i * F.lit(0.1)).alias("x"), (j * F.lit(0.1)).alias("y"))
    return spatial.match_points(points, squares, keep=["area"], size=0.1).select("area", "place")


@register(
    """
SELECT facility, min(area) AS area, max(n) AS n FROM (
  SELECT c_nationkey AS facility, c_custkey AS area, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 7 END AS n FROM customer
) t WHERE n IS NOT DISTINCT FROM (SELECT max(CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 7 END) FROM customer c WHERE c.c_nationkey = t.facility)
GROUP BY facility"""
)
def top_with_missing_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest measure a group where a left join left some NULL: NULL comes last."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("facility"), F.col("c_custkey").alias("area"))
    some = customer.filter(F.col("area") % 3 != 0).select("area", (F.col("area") % 7).alias("n"))
    return top_per_group(customer.join(some, "area", "left"), ["facility"], "n", "area")


_TOP = """
, best AS (SELECT facility, max(n) AS n FROM hits GROUP BY facility)
, top AS (SELECT h.facility, min(h.geo_code) AS geo_code, h.n FROM hits h JOIN best m ON m.facility = h.facility AND m.n = h.n
          GROUP BY h.facility, h.n)"""


@register(using(SPATIAL) + _TOP + " SELECT facility, geo_code, n FROM top")
def top_area_per_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.top_areas(plans.facility_counts(views.points_of_interest(spark, sf_dir), layer_of(spark, sf_dir)))


@register(
    using(SPATIAL)
    + _TOP
    + f"""
SELECT p.poi_id, p.name, t.geo_code FROM top t JOIN layer b ON b.geo_code = t.geo_code JOIN poi p ON {COVERED}
WHERE ((t.facility = 'pubs' AND p.value = 'pub') OR (t.facility = 'nightclubs' AND p.value = 'nightclub')) AND p.name IS NOT NULL"""
)
def points_of_top_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named pubs inside the area that has most of them, and the nightclubs inside theirs."""
    layer, points = layer_of(spark, sf_dir), views.points_of_interest(spark, sf_dir)
    tags = [t for t in plans.FACILITY_TAGS if t.column in ("pubs", "nightclubs")]
    top = plans.top_areas(plans.facility_counts(points, layer, tags)).select("geo_code", F.col("facility").alias("best"))
    chosen = layer.join(top, "geo_code").select("geo_code", "best", "rings")
    named = plans.select_tags(points, tags).select("poi_id", "name", "facility", "x", "y")
    matched = spatial.match_points(named, chosen, keep=["geo_code", "best"]).filter("facility = best")
    return matched.select("poi_id", "name", "geo_code")


@register(
    f"""
SELECT {area("c_custkey")} AS geo_code, k <> 5 AS closed, k <> 11 AS enough_points, k <> 17 AS no_repeats,
       k NOT IN (23, 31, 35) AS uncrossed, k NOT IN (29, 9) AS holes_inside, k NOT IN (1, 7) AS rings_apart, k NOT IN (2, 3, 9) AS interior_whole,
       k NOT IN (1, 2, 3, 5, 7, 9, 11, 23, 29, 31, 35) AS valid
FROM (SELECT c_custkey, c_custkey % 40 AS k FROM customer)"""
)
def ring_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_nesting.ring_validity(stage(views.unchecked_boundaries(spark, sf_dir), "layer"))


# Fixed values of the published definition, typed here once more so that the SQL does not share them with the library.
WGS84_A, WGS84_B = 6378137.0, 6356752.314245
AIRY_A, AIRY_B = 6377563.396, 6356256.909
SHIFT_X, SHIFT_Y, SHIFT_Z = -446.448, 125.157, -542.060
ROTATE_X_SEC, ROTATE_Y_SEC, ROTATE_Z_SEC = -0.1502, -0.2470, -0.8421
SCALE_PPM = 20.4894
GRID_F0, GRID_E0, GRID_N0 = 0.9996012717, 400000.0, -100000.0
WGS84_E2 = 1 - WGS84_B**2 / WGS84_A**2
AIRY_E2, AIRY_EP2 = 1 - AIRY_B**2 / AIRY_A**2, AIRY_A**2 / AIRY_B**2 - 1
GRID_N = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B)

_R = "0.017453292519943295"


def _projection_sql() -> str:
    k = 1 + SCALE_PPM * 1e-6
    rx, ry, rz = (f"({v}/3600.0::DOUBLE*{_R})" for v in (ROTATE_X_SEC, ROTATE_Y_SEC, ROTATE_Z_SEC))
    n = GRID_N
    return f"""
, a AS (SELECT poi_id, radians(lat) AS phi, radians(lon) AS lam FROM poi)
, b AS (SELECT *, {WGS84_A!r} / sqrt(1 - {WGS84_E2!r} * pow(sin(phi), 2)) AS nu FROM a)
, c AS (SELECT *, nu * cos(phi) * cos(lam) AS x, nu * cos(phi) * sin(lam) AS y, (1 - {WGS84_E2!r}) * nu * sin(phi) AS z FROM b)
, d AS (SELECT *, {SHIFT_X} + {k!r} * x - {rz} * y + {ry} * z AS x2, {SHIFT_Y} + {rz} * x + {k!r} * y - {rx} * z AS y2,
               {SHIFT_Z} - {ry} * x + {rx} * y + {k!r} * z AS z2 FROM c)
, e AS (SELECT *, sqrt(x2 * x2 + y2 * y2) AS p FROM d)
, q AS (SELECT *, atan2(z2 * {AIRY_A!r}, p * {AIRY_B!r}) AS q FROM e)
, l AS (SELECT *, atan2(z2 + {AIRY_EP2 * AIRY_B!r} * pow(sin(q), 3), p - {AIRY_E2 * AIRY_A!r} * pow(cos(q), 3)) AS f FROM q)
, g AS (SELECT poi_id, f, atan2(y2, x2) + 2 * {_R} AS d, sin(f) AS s, cos(f) AS c, pow(tan(f), 2) AS t,
               1 - {AIRY_E2!r} * pow(sin(f), 2) AS w FROM l)
, h AS (SELECT *, {AIRY_A * GRID_F0!r} / sqrt(w) AS v, {AIRY_A * GRID_F0!r} / sqrt(w) * (1 - {AIRY_E2!r}) / w AS r,
               f - 49 * {_R} AS less, f + 49 * {_R} AS more FROM g)
, grid AS (SELECT poi_id,
  {GRID_E0} + d * v * c + pow(d, 3) * v * pow(c, 3) * (v / r - t) / 6
    + pow(d, 5) * v * pow(c, 5) * (5 - 18 * t + t * t + 14 * (v / r - 1) - 58 * t * (v / r - 1)) / 120 AS easting,
  {GRID_N0} + {AIRY_B * GRID_F0!r} * ({1 + n + 1.25 * n**2 + 1.25 * n**3!r} * less
      - {3 * n + 3 * n**2 + 2.625 * n**3!r} * sin(less) * cos(more) + {1.875 * n**2 + 1.875 * n**3!r} * sin(2 * less) * cos(2 * more)
      - {35 / 24 * n**3!r} * sin(3 * less) * cos(3 * more))
    + d * d * v * s * c / 2 + pow(d, 4) * v * s * pow(c, 3) * (5 - t + 9 * (v / r - 1)) / 24
    + pow(d, 6) * v * s * pow(c, 5) * (61 - 58 * t + t * t) / 720 AS northing
FROM h)"""


@register(using(POI) + _projection_sql() + " SELECT poi_id, round(easting, 3) AS easting, round(northing, 3) AS northing FROM grid")
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = project(views.points_of_interest(spark, sf_dir).select("poi_id", "lon", "lat"))
    return out.select("poi_id", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing"))


@register(
    using(BOUNDARIES, POI)
    + _projection_sql()
    + f"""
, placed AS (SELECT poi_id, (easting - {views.GRID_EAST}) / {views.GRID_SCALE_X} AS x, northing / {views.GRID_SCALE_Y} AS y FROM grid)
SELECT b.geo_code, count(*) AS n FROM boundaries b JOIN placed p ON {COVERED} GROUP BY b.geo_code"""
)
def projected_poi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longitude and latitude to grid metres, then counted in a layer given in metres."""
    points = views.points_of_interest(spark, sf_dir).select("poi_id", "lon", "lat")
    areas = views.metric_boundaries(spark, sf_dir)
    placed = stage(plans.projected_in_box(points, areas).select("poi_id", "x", "y"), "projected")
    matched = spatial.match_points(placed, areas)
    return matched.groupBy("geo_code").agg(F.count(F.lit(1)).alias("n"))


_LONLAT = FACILITIES.replace(
    POI,
    POI.replace("poi AS (", "raw AS (", 1)
    + _projection_sql().replace("FROM poi)", "FROM raw)", 1)
    + f""", poi AS (
  SELECT raw.poi_id, key, value, name, (easting - {views.GRID_EAST}) / {views.GRID_SCALE_X} AS x, northing / {views.GRID_SCALE_Y} AS y
  FROM raw JOIN grid ON grid.poi_id = raw.poi_id
)""",
)


@register(using(_LONLAT) + " SELECT * FROM facilities")
def facility_table_lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in degrees to the facility table in one path: box in degrees, projection, counts by tag."""
    areas = analysed_boundaries(views.metric_boundaries(spark, sf_dir), views.EXCLUDED_LABELS)
    return plans.facility_table_lonlat(views.points_of_interest(spark, sf_dir).drop("x", "y"), areas)


@register(using(POI) + " SELECT poi_id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM poi")
def unproject_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees to the grid and back: the degrees that the points had, to seven places (a centimetre)."""
    points = views.points_of_interest(spark, sf_dir).select("poi_id", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"))
    back = unproject(project(points, "lon0", "lat0"))
    return back.select("poi_id", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@register(
    using(POI)
    + """
SELECT key, value, count(*) AS n_points, count(DISTINCT (x, y)) AS n_places, count(*) - count(DISTINCT (x, y)) AS n_repeats
FROM poi GROUP BY key, value"""
)
def places_per_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.places_per_tag(views.points_of_interest(spark, sf_dir))


@register(
    using(FACILITIES)
    + """
, cities AS (SELECT unnest(['North', 'South', 'East', 'West', 'Upper', 'Lower']) AS city,
                    unnest(['NATION_2', 'NATION_24', 'NATION_5 ', 'NATION_6 ', 'NATION_8 ', 'NATION_9 ']) AS pattern)
, members AS (SELECT c.city, f.geo_code, f.trains, nightlife_total + transport_total + bikes + shops_total AS facility_sum
              FROM facilities f JOIN cities c ON contains(f.geo_label, c.pattern))
SELECT city, geo_code, trains, facility_sum,
       CAST(facility_sum = max(facility_sum) OVER (PARTITION BY city) AS INTEGER) AS centre1,
       CAST(trains = max(trains) OVER (PARTITION BY city) AS INTEGER) AS centre2
FROM members"""
)
def city_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = plans.city_centres(facilities_of(spark, sf_dir), views.CITIES)
    return flagged.select("city", "geo_code", "trains", "facility_sum", "centre1", "centre2")


_TITLES = """
, titled AS (SELECT area_code, l.traj, '[' || l.traj || ']' AS title FROM area_labels l)"""

_STATS = ", ".join(
    f"avg({c}) AS m_{c}, median({c}) AS d_{c}, stddev_samp({c}) AS s_{c}"
    for c in ("nightlife_total", "shops_total", "transport_total", "bikes")
)


def _stat_columns() -> str:
    names = {"Nightlife": "nightlife_total", "Shops": "shops_total", "Public transport": "transport_total", "Bike parking": "bikes"}
    return ", ".join(
        f'round({p}_{c}, 6) AS "{title} ({s})"' for title, c in names.items() for s, p in (("mean", "m"), ("median", "d"), ("SD", "s"))
    )


def statistics_of(spark: SparkSession, sf_dir: str, digits: int | None) -> DataFrame:
    table = facilities_of(spark, sf_dir)
    labels = views.fixed_labels(spark, sf_dir)
    titled = labels.withColumn("traj_title", F.format_string("[%s]", F.col("traj")))
    joined = titled.join(table, F.col("area_code") == F.col("geo_code"), "left")
    return plans.cluster_statistics(joined, digits=digits)


@register(
    using(FACILITIES, FIXED_LABELS)
    + _TITLES
    + f"""
, stats AS (SELECT title, {_STATS} FROM titled LEFT JOIN facilities ON geo_code = area_code GROUP BY title)
SELECT title AS traj_title, {_stat_columns()} FROM stats"""
)
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = statistics_of(spark, sf_dir, None)
    return stats.select("traj_title", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in stats.columns if c != "traj_title"])


def _transposed_sql() -> str:
    names = {"Nightlife": "nightlife_total", "Shops": "shops_total", "Public transport": "transport_total", "Bike parking": "bikes"}
    two = "round_even(round(100 * {v}, 7), 0) / 100"
    rows = [
        f"SELECT title, '{title} ({s})' AS statistic, {two.format(v=f'{p}_{c}')} AS v FROM stats"
        for title, c in names.items()
        for s, p in (("mean", "m"), ("median", "d"), ("SD", "s"))
    ]
    cols = ", ".join(f"max(CASE WHEN title = '[{k}]' THEN v END) AS \"[{k}]\"" for k in "ABCDEF")
    return f", long AS ({' UNION ALL '.join(rows)}) SELECT statistic, {cols} FROM long GROUP BY statistic"


@register(
    using(FACILITIES, FIXED_LABELS)
    + _TITLES
    + f", stats AS (SELECT title, {_STATS} FROM titled LEFT JOIN facilities ON geo_code = area_code GROUP BY title)"
    + _transposed_sql()
)
def cluster_stats_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.transposed_statistics(statistics_of(spark, sf_dir, 2), [f"[{k}]" for k in "ABCDEF"])


@register(
    using(BOUNDARIES, FIXED_LABELS)
    + """
SELECT b.geo_code AS area_code, b.geo_label, l.traj FROM boundaries b
LEFT JOIN area_labels l ON l.area_code = b.geo_code AND l.traj NOT IN ('E', 'F')"""
)
def right_join_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every polygon keeps its place; areas of the two smallest clusters are left unlabelled."""
    labels = views.fixed_labels(spark, sf_dir).filter(~F.col("traj").isin("E", "F"))
    polygons = views.boundaries(spark, sf_dir).select("geo_code", "geo_label")
    return plans.labelled_layer(labels, polygons)


@register(
    using(FACILITIES, FIXED_LABELS)
    + """
SELECT b.geo_code AS area_code, b.geo_label, l.traj, f.pubs, f.shops_total FROM boundaries b
LEFT JOIN area_labels l ON l.area_code = b.geo_code
LEFT JOIN facilities f ON f.geo_code = b.geo_code AND f.geo_label = b.geo_label"""
)
def left_join_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    polygons = views.boundaries(spark, sf_dir).select("geo_code", "geo_label")
    layer = plans.labelled_layer(views.fixed_labels(spark, sf_dir), polygons)
    counts = facilities_of(spark, sf_dir).select("geo_code", "geo_label", "pubs", "shops_total")
    return plans.layer_with_facilities(layer, counts)


@register(
    using(FACILITIES)
    + " SELECT CAST(sum(nightlife_total) AS BIGINT) AS nightlife, CAST(sum(shops_total) AS BIGINT) AS shops FROM facilities"
)
def facility_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facilities_of(spark, sf_dir).agg(F.sum("nightlife_total").alias("nightlife"), F.sum("shops_total").alias("shops"))
