"""File scans and sinks: incident CSV drops, facility CSV, boundary and point layers."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyward.functions.text import clean_names

INCIDENT_FILE_SCHEMA = T.StructType(
    [
        T.StructField("Crime ID", T.StringType()),
        T.StructField("Month", T.StringType()),
        T.StructField("Reported by", T.StringType()),
        T.StructField("Falls within", T.StringType()),
        T.StructField("Longitude", T.DoubleType()),
        T.StructField("Latitude", T.DoubleType()),
        T.StructField("Location", T.StringType()),
        T.StructField("LSOA code", T.StringType()),
        T.StructField("LSOA name", T.StringType()),
        T.StructField("Crime type", T.StringType()),
        T.StructField("Last outcome category", T.StringType()),
        T.StructField("Context", T.StringType()),
    ]
)

RING_TYPE = "array<array<struct<x:double,y:double>>>"

GEOJSON_FEATURE = (
    "type string, properties map<string,string>, "
    "geometry struct<type:string,coordinates:string>"
)

POINT_FEATURE = (
    "type string, id string, properties map<string,string>, "
    "geometry struct<type:string,coordinates:array<double>>"
)

# The tag keys under which facilities are listed.
POINT_TAG_KEYS = ("amenity", "shop", "railway", "highway")


def csv_headers(spark: SparkSession, roots: Sequence[str], name_glob: str) -> dict[tuple[str, ...], list[str]]:
    """The files below ``roots`` by the column names in their first line. The driver reads one line of each file."""
    listed = spark.read.option("pathGlobFilter", name_glob).option("recursiveFileLookup", True).text(list(roots)).inputFiles()
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    found: dict[tuple[str, ...], list[str]] = {}
    for file in listed:
        path = hadoop.Path(spark._jvm.java.net.URI(file))
        stream = path.getFileSystem(conf).open(path)
        try:
            line = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
        finally:
            stream.close()
        if line is not None:
            found.setdefault(tuple(next(csv.reader([line.removeprefix("\ufeff")]))), []).append(path.toString())
    return found


def read_csv_tree(
    spark: SparkSession,
    root: str | Sequence[str],
    schema: T.StructType,
    name_glob: str = "*.csv",
    year_pattern: str | None = None,
    with_path: bool = False,
) -> DataFrame:
    """Every matching CSV below ``root``, one scan for each order of columns that occurs.

    Columns are bound by the names in the files' first lines: a column that is not in ``schema`` is left out, one that a
    file lacks is NULL there. ``year_pattern`` (one capture group, matched on the file path) adds a ``year`` column
    taken from the file, not from the rows; ``with_path`` adds ``file_path``.
    """
    roots = [root] if isinstance(root, str) else list(root)
    kinds = {f.name: f.dataType for f in schema.fields}
    of_file = {} if year_pattern is None else {"_file_year": F.regexp_extract(F.col("_metadata.file_path"), year_pattern, 1)}
    if with_path:
        of_file["_file_path"] = F.col("_metadata.file_path")
    frames = []
    for names, paths in csv_headers(spark, roots, name_glob).items():
        own = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
        df = spark.read.schema(own).option("header", True).option("enforceSchema", False).csv(paths)
        columns = [F.col(f"`{n}`") if n in names else F.lit(None).cast(k).alias(n) for n, k in kinds.items()]
        frames.append(df.select(*columns, *(e.alias(n) for n, e in of_file.items())))
    if not frames:
        frames.append(spark.createDataFrame([], T.StructType([*schema.fields, *(T.StructField(n, T.StringType()) for n in of_file)])))
    return clean_names(union_all(frames)).withColumnsRenamed({"file_year": "year"})


STREET_YEAR = r"/(\d{4})[^/]*street\.csv$"


def read_incident_years(spark: SparkSession, root: str, years: Sequence[str]) -> DataFrame:
    """Monthly street-level drops of the given years, named ``<year>-<month>-<force>-street.csv``."""
    names = "{" + ",".join(f"{y}*street.csv" for y in years) + "}"
    return read_csv_tree(spark, root, INCIDENT_FILE_SCHEMA, names, STREET_YEAR)


def list_files(spark: SparkSession, roots: str | Sequence[str], name_glob: str) -> DataFrame:
    """``path`` (as an URI), ``size`` and ``changed`` of the files below ``roots``. Spark lists them; their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", name_glob).option("recursiveFileLookup", True)
    found = found.load([roots] if isinstance(roots, str) else list(roots))
    parts = {"path": "file_path", "size": "file_size", "changed": "file_modification_time"}
    return found.select(*(F.col(f"_metadata.{c}").alias(n) for n, c in parts.items()))


def read_incident_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Street-level files by path, with the names that the panel uses and ``file_path``."""
    rows = read_csv_tree(spark, paths, INCIDENT_FILE_SCHEMA, "*street.csv", STREET_YEAR, with_path=True)
    return rows.withColumnsRenamed({"lsoa_code": "area_code", "crime_type": "category"})


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; a column missing in one of them becomes NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV whose columns have the order of ``schema``; another order is an error, not a swap."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("errorifexists").csv(path)


def write_panel(df: DataFrame, path: str, by: str = "year") -> None:
    """Parquet partitioned by year, so that later reads prune whole years.

    Rebalancing gathers each year's rows into few files and splits a year that is too large for one task.
    """
    df.hint("rebalance", by).write.partitionBy(by).mode("errorifexists").parquet(path)


def read_boundary_lines(
    spark: SparkSession, path: str, code: str = "geo_code", label: str = "geo_label", properties: dict[str, str] | None = None
) -> DataFrame:
    """Boundary layer from newline-delimited GeoJSON features (Polygon or MultiPolygon).

    ``rings`` has the rings of all parts, and ``part_sizes`` how many belong to each: even-odd counting over them treats
    holes and parts alike, and ``parts_of`` gives the parts back. Further ``properties`` (name in the file to column) come
    as text. Lines of other kinds have NULL rings; ``boundary_faults`` counts them.
    """
    feature = F.from_json(F.col("value"), GEOJSON_FEATURE)
    raw = spark.read.text(path).select(feature.alias("f"))
    points = "array<array<array<double>>>"
    single = F.array(F.from_json(F.col("f.geometry.coordinates"), points))
    multi = F.from_json(F.col("f.geometry.coordinates"), f"array<{points}>")
    parts = F.when(F.col("f.geometry.type") == "MultiPolygon", multi).when(F.col("f.geometry.type") == "Polygon", single)
    extra = [F.col("f.properties").getItem(name).alias(column) for name, column in (properties or {}).items()]
    named = raw.select(F.col("f.properties").getItem(code).alias("geo_code"), F.col("f.properties").getItem(label).alias("geo_label"), *extra, parts.alias("_parts"))
    ring = lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    rings = F.transform(F.flatten("_parts"), ring).cast(RING_TYPE).alias("rings")
    return named.select(*[c for c in named.columns if c != "_parts"], rings, F.transform("_parts", F.size).alias("part_sizes"))


def boundary_faults(spark: SparkSession, path: str) -> DataFrame:
    """How many lines of a boundary file are no area: ``fault`` (unreadable, or the other kind of geometry) and ``n``."""
    feature = F.from_json(F.col("value"), GEOJSON_FEATURE)
    kind = spark.read.text(path).select(feature["geometry"]["type"].alias("kind"))
    bad = kind.filter(F.coalesce(~F.col("kind").isin("Polygon", "MultiPolygon"), F.lit(True)))
    return bad.groupBy(F.coalesce("kind", F.lit("unreadable")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


def parts_of(rings: Column, part_sizes: Column) -> Column:
    """Rings as parts, each a list of its rings with the shell first."""
    before = F.transform(F.sequence(F.lit(1), F.size(part_sizes)), lambda i: F.aggregate(F.slice(part_sizes, 1, i - 1), F.lit(1), lambda s, n: s + n))
    return F.zip_with(before, part_sizes, lambda at, n: F.slice(rings, at, n))


def read_point_lines(spark: SparkSession, path: str, tag_keys: Sequence[str] = POINT_TAG_KEYS) -> DataFrame:
    """Points of interest from newline-delimited GeoJSON: one row per point and tag, other shapes are left out."""
    feature = F.from_json(F.col("value"), POINT_FEATURE)
    raw = spark.read.text(path).select(feature.alias("f")).filter(F.col("f.geometry.type") == "Point")
    wanted = F.map_filter("f.properties", lambda k, v: k.isin(*tag_keys) & v.isNotNull())
    return raw.select(
        F.col("f.id").alias("poi_id"),
        F.explode(wanted).alias("key", "value"),
        F.col("f.properties").getItem("name").alias("name"),
        F.col("f.geometry.coordinates")[0].alias("lon"),
        F.col("f.geometry.coordinates")[1].alias("lat"),
    )


def write_boundary_lines(df: DataFrame, path: str) -> None:
    """Boundary layer as newline-delimited GeoJSON; other scalar columns become properties.

    With ``part_sizes``, areas of several parts are written as MultiPolygon; without it every area is one Polygon.
    """
    pair = lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    polygon = F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(pair(F.col("rings"))), F.lit("}"))
    geometry = polygon
    if "part_sizes" in df.columns:
        parts = F.transform(parts_of(F.col("rings"), F.col("part_sizes")), pair)
        several = F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(parts), F.lit("}"))
        geometry = F.when(F.size("part_sizes") > 1, several).otherwise(polygon)
    properties = F.to_json(F.struct(*[c for c in df.columns if c not in ("rings", "part_sizes")]))
    line = F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), geometry, F.lit("}"))
    df.select(line.alias("value")).write.mode("errorifexists").text(path)


def write_boundary_layer(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)
