"""Filters, recodes, joins, frequency tables and the quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyward.catalog.panel_queries import panel_of
from tallyward.catalog.registry import register
from tallyward.catalog.sql_views import FIXED_LABELS, INCIDENTS, PANEL, POI, area, using
from tallyward.functions.text import first_chars, from_position, month_name, month_of, ordinal, recode
from tallyward.operators.counts import count_by, share_of_total
from tallyward.operators.rows import bounded, drop_values, keep_values, left_match
from tallyward.operators.ring_nesting import ring_validity
from tallyward.operators.selection import quantiles
from tallyward.plans.quality import quality_report as report
from tallyward.sources import role_views as views
from tallyward.sources.staging import stage


@register(
    using(INCIDENTS)
    + """ SELECT incident_id, month, category, area_code FROM incidents
WHERE category = '1-URGENT' OR category = '2-HIGH' OR category = '3-MEDIUM'"""
)
def category_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keep_values(views.incidents(spark, sf_dir), "category", views.LONG_RUN_CATEGORIES)
    return rows.select("incident_id", "month", "category", "area_code")


@register(
    using(INCIDENTS)
    + """ SELECT incident_id, month, category FROM incidents
WHERE category <> '4-NOT SPECIFIED' AND category <> '5-LOW' AND area_code <> 'E000000000042'"""
)
def category_and_area_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drop_values(views.incidents(spark, sf_dir), "category", views.NON_NOTIFIABLE)
    return drop_values(rows, "area_code", ["E000000000042"]).select("incident_id", "month", "category")


@register(
    using(INCIDENTS)
    + """
SELECT incident_id,
       CASE left(area_code, 1) WHEN 'E' THEN 'England' WHEN 'W' THEN 'Wales' ELSE left(area_code, 1) END AS country,
       left(monthname(CAST(month || '-01' AS DATE)), 3) AS month_abbr, lower(monthname(CAST(month || '-01' AS DATE))) AS month_lower,
       substr(month, 6) AS month_number, CAST(substr(month, 6) AS INTEGER) AS month_int,
       CASE WHEN split_part(month, '-', 2) BETWEEN '02' AND '08' THEN CAST(split_part(month, '-', 2) AS INTEGER) - 1 END AS season_order,
       CASE WHEN x > 25 THEN 1 WHEN x <= 25 THEN 0 END AS east
FROM incidents"""
)
def conditional_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.incidents(spark, sf_dir)
    month = F.col("month")
    return rows.select(
        "incident_id",
        recode(first_chars(F.col("area_code"), 1), {"E": "England", "W": "Wales"}).alias("country"),
        first_chars(month_name(month), 3).alias("month_abbr"),
        F.lower(month_name(month)).alias("month_lower"),
        from_position(month, 6).alias("month_number"),
        from_position(month, 6).cast("int").alias("month_int"),
        ordinal(month_of(month), ["02", "03", "04", "05", "06", "07", "08"]).alias("season_order"),
        (F.col("x") > 25).cast("int").alias("east"),
    )


@register(
    using(INCIDENTS, FIXED_LABELS)
    + """
SELECT i.incident_id, i.area_code, l.traj FROM incidents i
LEFT JOIN area_labels l ON l.area_code = i.area_code AND l.traj <> 'F'"""
)
def left_join_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = drop_values(views.fixed_labels(spark, sf_dir), "traj", ["F"])
    rows = views.incidents(spark, sf_dir).select("incident_id", "area_code")
    return left_match(rows, labels, {"area_code": "area_code"})


@register(
    using(INCIDENTS)
    + """
, prefixes AS (SELECT DISTINCT left(area_code, 1) AS prefix FROM incidents)
, named AS (SELECT prefix, CASE WHEN prefix IS NULL THEN 'none' ELSE 'code ' || prefix END AS meaning FROM prefixes)
SELECT i.incident_id, n.meaning FROM incidents i LEFT JOIN named n ON n.prefix IS NOT DISTINCT FROM left(i.area_code, 1)"""
)
def null_safe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A NULL key finds the NULL row of the other table."""
    rows = views.incidents(spark, sf_dir).select("incident_id", first_chars(F.col("area_code"), 1).alias("prefix"))
    named = rows.select("prefix").distinct().withColumn(
        "meaning", F.when(F.col("prefix").isNull(), "none").otherwise(F.concat(F.lit("code "), F.col("prefix")))
    )
    return left_match(rows, bounded(named, "prefixes"), {"prefix": "prefix"}).select("incident_id", "meaning")


@register(
    using(INCIDENTS)
    + """
, f AS (SELECT left(area_code, 1) AS prefix, count(*) AS n FROM incidents GROUP BY 1)
SELECT prefix, n, round(100.0 * n / sum(n) OVER (), 6) AS pct FROM f"""
)
def prefix_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency table with percent of all rows; NULL is a level."""
    rows = views.incidents(spark, sf_dir).select(first_chars(F.col("area_code"), 1).alias("prefix"))
    return share_of_total(count_by(rows, ["prefix"])).withColumn("pct", F.round("pct", 6))


@register(using(INCIDENTS) + " SELECT category, month, area_code, year, count(*) AS n FROM incidents GROUP BY ALL")
def counts_by_four_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by(views.incidents(spark, sf_dir), ["category", "month", "area_code", "year"])


@register(using(INCIDENTS) + " SELECT DISTINCT area_code, reported_by FROM incidents ORDER BY area_code, reported_by")
def distinct_area_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.incidents(spark, sf_dir).select("area_code", "reported_by").distinct().orderBy("area_code", "reported_by")


@register(
    using(INCIDENTS)
    + """
SELECT year, count(DISTINCT area_code) AS n_areas, count(DISTINCT month) AS n_months, count(DISTINCT category) AS n_categories
FROM incidents GROUP BY year"""
)
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = {"area_code": "n_areas", "month": "n_months", "category": "n_categories"}
    rows = views.incidents(spark, sf_dir)
    return rows.groupBy("year").agg(*[F.count_distinct(c).alias(n) for c, n in distinct.items()])


_PRICE = "CAST(l_extendedprice AS DOUBLE)"


@register(
    f"""
SELECT l_returnflag, {", ".join(f"round(quantile_cont({_PRICE}, {p}), 6) AS {n}" for n, p in (("tenth", 0.1), ("median", 0.5), ("ninetieth", 0.9)))}
FROM (SELECT CASE WHEN l_linenumber = 1 THEN l_returnflag ELSE 'hot' END AS l_returnflag, l_extendedprice FROM lineitem) GROUP BY l_returnflag"""
)
def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of real values; most rows are one group, which no task sees whole."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    flag = F.when(F.col("l_linenumber") == 1, F.col("l_returnflag")).otherwise("hot").alias("l_returnflag")
    at = {"tenth": 0.1, "median": 0.5, "ninetieth": 0.9}
    found = quantiles(rows.select(flag, "l_extendedprice"), ["l_returnflag"], "l_extendedprice", at, limit=5000)
    return found.select("l_returnflag", *(F.round(n, 6).alias(n) for n in at))


@register(f"SELECT {area('c_custkey')} AS geo_code FROM customer WHERE c_custkey % 40 IN (1, 2, 3, 5, 7, 9, 11, 23, 29, 31, 35)")
def invalid_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_validity(stage(views.unchecked_boundaries(spark, sf_dir), "layer")).filter(~F.col("valid")).select("geo_code")


def _missing(name: str, condition: str) -> str:
    return f"SELECT '{name}' AS \"check\", year AS detail, count(*) FILTER ({condition}) AS value FROM incidents GROUP BY year"


@register(
    using(PANEL, POI)
    + """, seen AS (SELECT DISTINCT year, area_code FROM panel)
"""
    + " UNION ALL ".join(
        [
            _missing("missing_month", "month IS NULL"),
            _missing("missing_category", "category IS NULL"),
            _missing("missing_area_code", "area_code IS NULL"),
            _missing("missing_area_and_x", "area_code IS NULL AND x IS NULL"),
            _missing("missing_area_and_y", "area_code IS NULL AND y IS NULL"),
            "SELECT 'areas', year, count(*) FROM seen GROUP BY year",
            "SELECT 'areas_by_prefix', year || ':' || left(area_code, 1), count(*) FROM seen GROUP BY ALL",
            "SELECT 'boundary_valid', CASE WHEN c_custkey % 40 IN (1, 2, 3, 5, 7, 9, 11, 23, 29, 31, 35) THEN 'false' ELSE 'true' END, count(*) FROM customer GROUP BY ALL",
            "SELECT 'panel_total', year, CAST(sum(n) AS BIGINT) FROM panel GROUP BY year",
            "SELECT 'boundary_without_panel', year, (SELECT count(*) FROM boundaries) - count(b.geo_code) FROM seen LEFT JOIN boundaries b ON b.geo_code = area_code GROUP BY year",
            "SELECT 'panel_without_boundary', year, count(*) - count(b.geo_code) FROM seen LEFT JOIN boundaries b ON b.geo_code = area_code GROUP BY year",
            "SELECT 'point_repeats', key || '=' || value, count(*) - count(DISTINCT (x, y)) FROM poi GROUP BY key, value",
        ]
    )
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.points_of_interest(spark, sf_dir)
    return report(views.incidents(spark, sf_dir), panel_of(spark, sf_dir), views.unchecked_boundaries(spark, sf_dir), points)
