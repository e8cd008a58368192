"""Facilities per area: counts of tagged points, totals, city centres and statistics by cluster."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyward.functions.national_grid import project, unproject
from tallyward.functions.numbers import half_even, positive_flag, round_numeric, row_sum
from tallyward.functions.text import first_chars
from tallyward.operators.counts import exact_quantiles
from tallyward.operators.rows import flag_group_maximum, left_match, right_match, top_per_group
from tallyward.operators.spatial import LayerProfile, match_points, profile_layer, within_box
from tallyward.sources.staging import stage


@dataclass(frozen=True)
class Tag:
    """One kind of facility. Named kinds count named points; the others count distinct places."""

    column: str
    key: str
    value: str
    total: str | None = None
    named: bool = True


# The tags that are counted and the totals they belong to.
FACILITY_TAGS = (
    Tag("pubs", "amenity", "pub", "nightlife_total"),
    Tag("nightclubs", "amenity", "nightclub", "nightlife_total"),
    Tag("restaurants", "amenity", "restaurant", "nightlife_total"),
    Tag("clothes_shops", "shop", "clothes", "shops_total"),
    Tag("shoe_shops", "shop", "shoes", "shops_total"),
    Tag("malls_shops", "shop", "mall", "shops_total"),
    Tag("deps_shops", "shop", "department_store", "shops_total"),
    Tag("supermarks_shops", "shop", "supermarket", "shops_total"),
    Tag("cosmetic_shops", "shop", "cosmetics"),
    Tag("electric_shops", "shop", "electrical", "shops_total"),
    Tag("chemist_shops", "shop", "chemist", "shops_total"),
    Tag("greengrocer_shops", "shop", "greengrocer", "shops_total"),
    Tag("trains", "railway", "station", "transport_total"),
    Tag("bus", "highway", "bus_stop", "transport_total"),
    Tag("bikes", "amenity", "bicycle_parking", named=False),
    Tag("car_spaces", "amenity", "parking_space", named=False),
    Tag("car_parkings", "amenity", "parking_entrance", named=False),
    Tag("moto_parkings", "amenity", "motorcycle_parking", named=False),
    Tag("conveniences", "shop", "convenience", "shops_total", named=False),
)
TOTALS = ("nightlife_total", "shops_total", "transport_total")
FACILITY_SUM = ("nightlife_total", "transport_total", "bikes", "shops_total")


def select_tags(points: DataFrame, tags: Sequence[Tag] = FACILITY_TAGS) -> DataFrame:
    """Points of the listed tags in one scan, with the facility they count for.

    The list is a constant map, and membership of the tag value is a plain filter that reaches the scan.
    Unnamed points of named kinds go.
    """
    entries = ", ".join(f"'{t.key}={t.value}', '{t.column}'" for t in tags)
    facility = F.try_element_at(F.expr(f"map({entries})"), F.concat_ws("=", "key", "value"))
    counted = F.col("facility").isNotNull()
    by_place = [t.column for t in tags if not t.named]
    if len(by_place) < len(tags):
        counted = counted & (F.col("name").isNotNull() | F.col("facility").isin(*by_place))
    listed = points.filter(F.col("value").isin(*sorted({t.value for t in tags})))
    return listed.withColumn("facility", facility).filter(counted)


def countable_points(points: DataFrame, tags: Sequence[Tag] = FACILITY_TAGS) -> DataFrame:
    """Selected points merged by place: ``weight`` is 1 for kinds counted by place, else the number of points.

    Copies at one spot collapse before the spatial join, however many there are.
    """
    by_place = [t.column for t in tags if not t.named]
    merged = select_tags(points, tags).groupBy("facility", "x", "y").agg(F.count(F.lit(1)).alias("weight"))
    single = F.col("facility").isin(*by_place) if by_place else F.lit(False)
    return merged.withColumn("weight", F.when(single, F.lit(1).cast("long")).otherwise(F.col("weight")))


def _matched(points: DataFrame, polygons: DataFrame, tags: Sequence[Tag]) -> DataFrame:
    layer = profile_layer(polygons)
    places = stage(countable_points(within_box(points, layer), tags), "places")
    return match_points(places, polygons, size=layer.extent)


def facility_counts(points: DataFrame, polygons: DataFrame, tags: Sequence[Tag] = FACILITY_TAGS) -> DataFrame:
    """Area x facility counts of the areas that have any; one spatial join for all tags."""
    return _matched(points, polygons, tags).groupBy("geo_code", "facility").agg(F.sum("weight").alias("n"))


def zero_filled_facilities(counts: DataFrame, polygons: DataFrame, tags: Sequence[Tag] = FACILITY_TAGS) -> DataFrame:
    """Every polygon with every facility; absent pairs count 0.

    Counts and polygons meet by code, a row each, and become a row per facility only after that: one task may scan the whole
    layer, and must not group every pair of it.
    """
    entry = F.struct("facility", "n")
    found = counts.select("geo_code", entry.alias("found"), F.lit(False).alias("drawn"))
    drawn = polygons.select("geo_code", F.lit(None).cast(found.schema["found"].dataType).alias("found"), F.lit(True).alias("drawn"))
    met = found.union(drawn).groupBy("geo_code").agg(F.collect_list("found").alias("found"), F.max("drawn").alias("drawn"))
    all_names = F.array(*[F.lit(t.column) for t in tags])
    names = F.array_union(F.when(F.col("drawn"), all_names).otherwise(F.slice(all_names, 1, 0)), F.col("found")["facility"])
    long = met.select("geo_code", F.explode(names).alias("facility"), "found")
    own = F.filter("found", lambda f: f["facility"].eqNullSafe(F.col("facility")))
    return long.select("geo_code", "facility", F.aggregate(own, F.lit(0).cast("long"), lambda total, f: total + F.coalesce(f["n"], F.lit(0))).alias("n"))


def facility_table(points: DataFrame, polygons: DataFrame, tags: Sequence[Tag] = FACILITY_TAGS) -> DataFrame:
    """One row per polygon: a count per facility, totals and presence flags."""
    columns = [t.column for t in tags]
    wide = _matched(points, polygons, tags).groupBy("geo_code").agg(*[F.sum(F.when(F.col("facility") == c, F.col("weight"))).alias(c) for c in columns])
    full = polygons.select("geo_code", "geo_label").join(wide, "geo_code", "left").na.fill(0, columns)
    totals = {name: row_sum([t.column for t in tags if t.total == name]) for name in TOTALS if any(t.total == name for t in tags)}
    full = full.withColumns(totals)
    return full.withColumns({"train_bin": positive_flag(F.col("trains")), "bus_bin": positive_flag(F.col("bus"))})


def places_per_tag(points: DataFrame) -> DataFrame:
    """Points, distinct places and points that repeat a place, per tag. Points of one place meet before they are counted."""
    at = points.groupBy("key", "value", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    sums = at.groupBy("key", "value").agg(F.sum("n").alias("n_points"), F.count(F.lit(1)).alias("n_places"))
    return sums.withColumn("n_repeats", F.col("n_points") - F.col("n_places"))


BORDER_POINTS = 32
BORDER_MARGIN_DEG = 1e-4


def box_in_degrees(spark: SparkSession, box: LayerProfile) -> tuple[float, float, float, float]:
    """Longitudes and latitudes (low, high, low, high) around a box in grid metres, from points along its border."""
    parts = [i / BORDER_POINTS for i in range(BORDER_POINTS + 1)]
    xs = [box.minx + t * (box.maxx - box.minx) for t in parts]
    ys = [box.miny + t * (box.maxy - box.miny) for t in parts]
    border = [(x, y) for x in xs for y in (box.miny, box.maxy)] + [(x, y) for y in ys for x in (box.minx, box.maxx)]
    placed = unproject(spark.createDataFrame(border, "easting double, northing double"))
    low_lon, high_lon, low_lat, high_lat = placed.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    m = BORDER_MARGIN_DEG
    return low_lon - m, high_lon + m, low_lat - m, high_lat + m


def projected_in_box(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points given in degrees as ``x`` and ``y`` in grid metres, those around the layer only.

    The layer's box is compared in degrees, on the stored columns, before any point is projected.
    """
    low_lon, high_lon, low_lat, high_lat = box_in_degrees(points.sparkSession, profile_layer(polygons))
    near = points.filter(F.col("lon").between(low_lon, high_lon) & F.col("lat").between(low_lat, high_lat))
    return project(near, easting="x", northing="y")


def facility_table_lonlat(points: DataFrame, polygons: DataFrame, tags: Sequence[Tag] = FACILITY_TAGS) -> DataFrame:
    """The facility table of points in degrees (no ``x``, ``y``) and areas in grid metres."""
    return facility_table(stage(projected_in_box(points, polygons), "projected"), polygons, tags)


def with_facility_sum(table: DataFrame) -> DataFrame:
    return table.withColumn("facility_sum", row_sum(FACILITY_SUM))


def top_areas(counts: DataFrame) -> DataFrame:
    """The area with most points of each facility; equal counts resolve to the smallest code."""
    return top_per_group(counts, ["facility"], "n", "geo_code")


def city_centres(facilities: DataFrame, cities: dict[str, str], detached: Sequence[str] = ()) -> DataFrame:
    """Areas of the listed cities, flagged where they hold the city's maximum of all facilities or of stations.

    A label that fits two patterns belongs to both cities. Detached areas are taken out after flagging.
    """
    matches = F.array_compact(F.array(*[F.when(F.col("geo_label").rlike(p), F.lit(c)) for c, p in cities.items()]))
    members = stage(with_facility_sum(facilities).withColumn("city", F.explode(matches)), "members")
    flagged = flag_group_maximum(members, "city", {"centre1": "facility_sum", "centre2": "trains"})
    return flagged.filter(~F.col("geo_code").isin(*detached)) if detached else flagged


def labelled_layer(labels: DataFrame, polygons: DataFrame) -> DataFrame:
    """Every polygon with its cluster, if any."""
    return right_match(labels, polygons, {"area_code": "geo_code"})


def layer_with_facilities(layer: DataFrame, facilities: DataFrame) -> DataFrame:
    """Labelled polygons with their facility counts, matched on code and label."""
    return left_match(layer, facilities, {"area_code": "geo_code", "geo_label": "geo_label"})


STAT_MEASURES = {
    "Nightlife": "nightlife_total",
    "Shops": "shops_total",
    "Public transport": "transport_total",
    "Bike parking": "bikes",
}


def cluster_statistics(labelled: DataFrame, measures: dict[str, str] = STAT_MEASURES, digits: int | None = 2) -> DataFrame:
    """Mean, median and sample deviation of every measure per cluster, one row per cluster.

    All measures go through one frequency table (cluster, measure, value), whose shuffle key includes the
    value, so the largest cluster is merged by many tasks.
    """
    long = labelled.select("traj_title", *measures.values()).unpivot(["traj_title"], list(measures.values()), "measure", "v")
    freq = long.filter(F.col("v").isNotNull()).groupBy("traj_title", "measure", "v").agg(F.count(F.lit(1)).alias("freq"))
    keys = ["traj_title", "measure"]
    v = F.col("v").cast("double")
    moments = freq.groupBy(*keys).agg(
        F.sum("freq").alias("n"), F.sum(v * F.col("freq")).alias("s1"), F.sum(v * v * F.col("freq")).alias("s2")
    )
    variance = F.try_divide(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.col("n") - F.lit(1.0))
    stats = moments.join(exact_quantiles(freq, keys, "v", {"median": 0.5}), keys).select(
        *keys, F.try_divide(F.col("s1"), F.col("n")).alias("mean"), "median", F.sqrt(F.when(variance < 0, 0.0).otherwise(variance)).alias("sd")
    )
    cells = []
    for title, column in measures.items():
        for label, stat in (("mean", "mean"), ("median", "median"), ("SD", "sd")):
            cells.append(F.max(F.when(F.col("measure") == column, F.col(stat))).alias(f"{title} ({label})"))
    wide = stats.groupBy("traj_title").agg(*cells)
    return wide if digits is None else round_numeric(wide, digits)


def transposed_statistics(stats: DataFrame, titles: Sequence[str]) -> DataFrame:
    """Statistics as rows, clusters (first three characters of the title, e.g. ``[A]``) as columns."""
    short = stats.withColumn("traj_title", first_chars(F.col("traj_title"), 3))
    names = [c for c in stats.columns if c != "traj_title"]
    long = short.unpivot(["traj_title"], names, "statistic", "value")
    return long.groupBy("statistic").pivot("traj_title", list(titles)).agg(F.first("value"))
