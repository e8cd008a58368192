"""Panel, trend and key-reconciliation queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyward.catalog.registry import register
from tallyward.catalog.sql_views import BOUNDARIES, INCIDENTS, PANEL, using
from tallyward.operators.rows import keep_values, not_in
from tallyward.plans.drops import PanelFiles
from tallyward.plans.panel import CountPanel, build_panel, dense_counts, excluded_areas, usable_incidents
from tallyward.plans.reconcile import analysed_boundaries, area_counts, missing_areas
from tallyward.plans.settings import TOTAL_CATEGORY
from tallyward.plans.sketches import estimate, load_area_sketches, save_area_sketches, within_bound
from tallyward.plans.trends import long_run_trend as category_trend, main_measure_trend, trend_table as trends
from tallyward.sources import role_views as views
from tallyward.sources.files import INCIDENT_FILE_SCHEMA, read_csv_tree
from tallyward.sources.staging import fresh_path


def panel_of(spark: SparkSession, sf_dir: str, *years: str) -> CountPanel:
    return build_panel(
        views.incidents(spark, sf_dir, *years),
        views.boundaries(spark, sf_dir),
        views.EXCLUDED_PROVIDERS,
        views.EXCLUDED_LABELS,
        views.EXCLUDED_PREFIX,
    )


@register(using(PANEL) + " SELECT category, month, area_code, year, n FROM panel")
def count_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_of(spark, sf_dir).dense()


@register(using(PANEL) + " SELECT category, month, area_code, year, n FROM panel WHERE year = '1998'")
def panel_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel saved by year and loaded; one year of it, zero-filled."""
    path = fresh_path(spark, "saved-panel")
    panel_of(spark, sf_dir).save(path)
    loaded = CountPanel.load(spark, path)
    year = lambda df: keep_values(df, "year", ["1998"])
    return CountPanel(year(loaded.cells), year(loaded.levels)).dense()


def write_drops(rows: DataFrame, root: str) -> None:
    """Incidents as CSV files of the published shape, those of a month below ``drop=<month>``."""
    by_name = {
        "Month": F.col("month"),
        "Reported by": F.col("reported_by"),
        "Longitude": F.col("x"),
        "Latitude": F.col("y"),
        "LSOA code": F.col("area_code"),
        "Crime type": F.col("category"),
    }
    drop = rows.select(
        *[by_name.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in INCIDENT_FILE_SCHEMA], F.col("month").alias("drop")
    )
    drop.hint("rebalance", "drop").write.partitionBy("drop").mode("append").option("header", True).csv(root)


def _month_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files written below ``drop=<month>``, with the names that the panel uses."""
    rows = read_csv_tree(spark, paths, INCIDENT_FILE_SCHEMA, "*.csv", r"/drop=(\d{4})-\d{2}/", with_path=True)
    return rows.withColumnsRenamed({"lsoa_code": "area_code", "crime_type": "category"})


@register(using(PANEL) + " SELECT category, month, area_code, year, n FROM panel WHERE n > 0")
def incremental_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly files counted in three additions, the last of them a repeat, then put into one commit."""
    root, folder = fresh_path(spark, "drops"), fresh_path(spark, "panel-files")
    for some in (F.col("month") < "1996-01", F.col("month") >= "1996-01"):
        write_drops(views.incidents(spark, sf_dir).filter(some), root)
        PanelFiles(spark, folder).add(root, "*.csv", _month_files)
    ledger = PanelFiles(spark, folder)
    if ledger.add(root, "*.csv", _month_files):
        raise ValueError("a file was counted twice")
    ledger.compact()
    return ledger.panel(views.boundaries(spark, sf_dir), views.EXCLUDED_PROVIDERS, views.EXCLUDED_LABELS, views.EXCLUDED_PREFIX).cells


@register(
    using(PANEL)
    + """
SELECT year, span, count(DISTINCT area_code) AS n_areas, true AS within
FROM (SELECT *, UNNEST(CASE WHEN substr(month, 6) BETWEEN '02' AND '08' THEN ['season', 'year'] ELSE ['year'] END) AS span FROM panel WHERE n > 0)
GROUP BY year, span"""
)
def sketched_area_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas with incidents in each season and year from saved monthly sketches, held against the exact counts of the cells."""
    path, panel = fresh_path(spark, "sketched-panel"), panel_of(spark, sf_dir)
    save_area_sketches(panel, path)
    part = F.substring("month", 6, 2).between("02", "08")
    spans = F.explode(F.when(part, F.array(F.lit("season"), F.lit("year"))).otherwise(F.array(F.lit("year")))).alias("span")
    found = estimate(load_area_sketches(spark, path).select("year", spans, "sketch"), ["year", "span"])
    exact = panel.cells.select("year", spans, "area_code").groupBy("year", "span").agg(F.count_distinct("area_code").alias("n_areas"))
    both = exact.join(found, ["year", "span"])
    return both.select("year", "span", "n_areas", within_bound(F.col("n_distinct"), F.col("n_areas")).alias("within"))


@register(
    using(INCIDENTS)
    + """
, u AS (SELECT * FROM incidents WHERE area_code IS NOT NULL)
SELECT k.category, m.month, a.area_code, a.year, count(u.incident_id) AS n
FROM (SELECT DISTINCT year, area_code FROM u) a
JOIN (SELECT DISTINCT year, category FROM u) k ON k.year = a.year
JOIN (SELECT DISTINCT year, month FROM u) m ON m.year = a.year
LEFT JOIN u ON u.year = a.year AND u.month = m.month AND u.category = k.category AND u.area_code = a.area_code
GROUP BY ALL"""
)
def zero_filled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_counts(views.incidents(spark, sf_dir))


@register(
    using(PANEL)
    + f"""
, split AS (SELECT category, year, split_part(month, '-', 2) AS month, sum(n) AS n FROM panel GROUP BY ALL)
, both_parts AS (
  SELECT * FROM split
  UNION ALL
  SELECT '{TOTAL_CATEGORY}' AS category, year, month, sum(n) AS n FROM split
  WHERE category <> '4-NOT SPECIFIED' AND category <> '5-LOW' GROUP BY ALL
)
SELECT category, year, month, CAST(n AS BIGINT) AS n, CAST(month AS INTEGER) - 1 AS month_order FROM both_parts
WHERE month NOT IN ('01', '09', '10', '11', '12')"""
)
def trend_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends(panel_of(spark, sf_dir), views.NON_NOTIFIABLE, TOTAL_CATEGORY)


LATE_PERIODS = ("2001-06", "2001-07", "2001-08")

_POSITION = """CAST((CAST(year AS INTEGER) - 1995) * 12 + CAST(split_part(month, '-', 2) AS INTEGER) AS INTEGER) AS position"""


@register(
    using(PANEL)
    + f"""
SELECT category, month, year, CAST(sum(n) AS BIGINT) AS n, {_POSITION} FROM panel
WHERE (category = '1-URGENT' OR category = '2-HIGH' OR category = '3-MEDIUM')
  AND month <> '2001-06' AND month <> '2001-07' AND month <> '2001-08'
GROUP BY category, month, year"""
)
def long_run_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_trend(panel_of(spark, sf_dir), views.LONG_RUN_CATEGORIES, LATE_PERIODS)


@register(
    using(PANEL)
    + f"""
SELECT month, year, CAST(sum(n) AS BIGINT) AS n, {_POSITION} FROM panel
WHERE category NOT IN ('4-NOT SPECIFIED', '5-LOW') AND month NOT IN ('2001-06', '2001-07', '2001-08')
GROUP BY month, year"""
)
def long_run_main_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_measure_trend(panel_of(spark, sf_dir), views.NON_NOTIFIABLE, LATE_PERIODS)


@register(
    using(INCIDENTS)
    + """
SELECT incident_id, reported_by, month, category, area_code FROM incidents
WHERE reported_by <> 'NATION_3' AND reported_by <> 'NATION_7' AND area_code IS NOT NULL"""
)
def exclude_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = usable_incidents(views.incidents(spark, sf_dir), views.EXCLUDED_PROVIDERS)
    return kept.select("incident_id", "reported_by", "month", "category", "area_code")


@register(
    using(INCIDENTS, BOUNDARIES)
    + """
, gone AS (SELECT geo_code FROM boundaries WHERE geo_code LIKE '9%' OR regexp_matches(geo_label, 'NATION_3 |NATION_7 '))
SELECT incident_id, area_code FROM incidents
WHERE area_code IS NULL OR area_code NOT IN (SELECT geo_code FROM gone)"""
)
def not_in_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents outside the excluded areas; a NULL area is in no set, so it stays."""
    rows = views.incidents(spark, sf_dir).select("incident_id", "area_code")
    gone = excluded_areas(views.boundaries(spark, sf_dir), views.EXCLUDED_LABELS, views.EXCLUDED_PREFIX)
    return not_in(rows, "area_code", gone, "geo_code")


_ANALYSED = """
, kept_boundaries AS (
  SELECT * FROM boundaries WHERE (geo_code LIKE 'E%' OR geo_code LIKE 'W%')
    AND NOT regexp_matches(geo_label, 'NATION_3 |NATION_7 ')
)
, seen AS (SELECT DISTINCT area_code, year FROM panel)"""


@register(
    using(PANEL)
    + _ANALYSED
    + """
SELECT y.year, b.geo_code, b.geo_label FROM kept_boundaries b, (SELECT DISTINCT year FROM seen) y
WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.area_code = b.geo_code AND s.year = y.year)"""
)
def anti_join_missing_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panel_of(spark, sf_dir)
    kept = analysed_boundaries(views.boundaries(spark, sf_dir), views.EXCLUDED_LABELS)
    return missing_areas(panel, kept).select("year", "geo_code", "geo_label")


@register(
    using(PANEL)
    + _ANALYSED
    + """
SELECT 'boundaries' AS source, count(DISTINCT geo_code) AS n_areas FROM kept_boundaries
UNION ALL
SELECT 'boundaries_seen', count(DISTINCT geo_code) FROM kept_boundaries
WHERE geo_code IN (SELECT area_code FROM seen)
UNION ALL
SELECT 'panel_' || year, count(DISTINCT area_code) FROM seen GROUP BY year"""
)
def area_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = analysed_boundaries(views.boundaries(spark, sf_dir), views.EXCLUDED_LABELS)
    return area_counts(panel_of(spark, sf_dir), kept)


@register(
    using(INCIDENTS)
    + """ SELECT incident_id, month, category, x, y FROM incidents WHERE area_code IS NULL"""
)
def null_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.incidents(spark, sf_dir)
    return rows.filter(F.col("area_code").isNull()).select("incident_id", "month", "category", "x", "y")
