"""Trajectory tables and change, composition and distribution by cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyward.catalog.panel_queries import panel_of
from tallyward.catalog.registry import register
from tallyward.catalog.sql_views import FIXED_LABELS, PANEL, using
from tallyward.functions.numbers import half_even
from tallyward.operators.rows import drop_values, keep_values
from tallyward.operators.reshape import lengthen, split_stat_name, widen, widen_many
from tallyward.plans import change, distribution
from tallyward.plans.composition import composition, share_sums
from tallyward.plans.settings import MONTH_NAMES, MONTH_STEPS, study_periods
from tallyward.plans.trajectories import cluster_sizes as sizes, trajectory_clusters, trajectory_table as trajectories
from tallyward.sources import role_views as views
from tallyward.sources.staging import stage

YEAR, BASE = "2000", "1999"


def _six(name: str):
    return F.round(F.col(name), 6).alias(name)


def season_of(spark: SparkSession, sf_dir: str, *years: str) -> DataFrame:
    cells = panel_of(spark, sf_dir, *years).cells
    return change.season_counts(cells, views.fixed_labels(spark, sf_dir), years, views.NON_NOTIFIABLE)


_LABELLED = """
, labelled AS (
  SELECT p.*, l.traj, split_part(p.month, '-', 2) AS mm FROM panel p LEFT JOIN area_labels l ON l.area_code = p.area_code
  WHERE p.category NOT IN ('4-NOT SPECIFIED', '5-LOW') AND split_part(p.month, '-', 2) BETWEEN '02' AND '08'
)"""

_SEASON = using(PANEL, FIXED_LABELS) + _LABELLED

_WIDE = ", ".join(
    f"CAST(sum(CASE WHEN month = '{p}' THEN n ELSE 0 END) AS BIGINT) AS {name}"
    for p, name in zip(study_periods(YEAR), MONTH_NAMES)
)


@register(
    using(PANEL)
    + f"""
, wide AS (
  SELECT area_code, {_WIDE} FROM panel
  WHERE year = '2000' AND category NOT IN ('4-NOT SPECIFIED', '5-LOW') GROUP BY area_code
)
SELECT * FROM wide WHERE february + march + april + may + june + july + august <> 0"""
)
def trajectory_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectories(panel_of(spark, sf_dir, YEAR).cells, YEAR, views.NON_NOTIFIABLE)


@register(
    using(PANEL)
    + f"""
, wide AS (
  SELECT category, {_WIDE} FROM panel WHERE year = '2000' GROUP BY category
)
SELECT * FROM wide"""
)
def pivot_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = keep_values(panel_of(spark, sf_dir, YEAR).monthly(), "month", study_periods(YEAR))
    return widen(monthly, ["category"], "month", "n", dict(zip(study_periods(YEAR), MONTH_NAMES)))


_TOTALLED = """
, season AS (
  SELECT traj, mm, CAST(sum(n) AS BIGINT) AS n FROM labelled WHERE year = '2000' GROUP BY traj, mm
)
, totalled AS (SELECT traj, mm, n, CAST(sum(n) OVER (PARTITION BY mm) AS BIGINT) AS total FROM season)"""

_TWO = ", ".join(
    f"max(CASE WHEN mm = '0{i}' THEN {v} END) AS {v}_{name}"
    for v in ("n", "total")
    for i, name in enumerate(MONTH_NAMES, start=2)
)


@register(_SEASON + _TOTALLED + f" SELECT traj, {_TWO} FROM totalled GROUP BY traj")
def pivot_two_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = change.cluster_month_totals(season_of(spark, sf_dir, YEAR))
    return widen_many(totals, ["traj"], "month_name", ["n", "total"], {m: m for m in MONTH_NAMES})


@register(
    using(PANEL)
    + """
SELECT category, CASE split_part(month, '-', 2) WHEN '02' THEN 'february' WHEN '03' THEN 'march' WHEN '04' THEN 'april'
         WHEN '05' THEN 'may' WHEN '06' THEN 'june' WHEN '07' THEN 'july' ELSE 'august' END AS month_name,
       CAST(sum(n) AS BIGINT) AS n
FROM panel WHERE year = '2000' AND split_part(month, '-', 2) BETWEEN '02' AND '08' GROUP BY ALL"""
)
def unpivot_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengthen(pivot_months(spark, sf_dir), ["category"], "month_name", "n")


_STEPS = """
, placed AS (SELECT traj, CAST(mm AS INTEGER) AS m, n FROM season)
, steps AS (
  SELECT a.traj, a.m - 2 AS step_order, a.n - b.n AS count_change,
         (['feb_mar', 'mar_apr', 'apr_may', 'may_jun', 'jun_jul', 'jul_aug'])[a.m - 2] AS step
  FROM placed a JOIN placed b ON b.traj = a.traj AND b.m = a.m - 1
)
, shares AS (
  SELECT *, count_change / nullif(CAST(sum(abs(count_change)) OVER (PARTITION BY step) AS DOUBLE), 0) AS share FROM steps
)"""
_PROP = "round_even(round(100 * share, 7), 0)"


@register(
    _SEASON
    + _TOTALLED
    + _STEPS
    + f"""
SELECT traj, '2000' AS year, step, step_order, count_change, round(share, 6) AS share, {_PROP} AS prop_change,
       CAST(CAST(abs({_PROP}) AS BIGINT) AS VARCHAR) || '%' AS prop_label
FROM shares"""
)
def month_change_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = change.month_change_share(season_of(spark, sf_dir, YEAR))
    return shares.withColumn("share", F.round("share", 6))


@register(
    _SEASON
    + _TOTALLED
    + _STEPS
    + f"""
SELECT traj, step, CAST(count_change AS DOUBLE) AS count_change, {_PROP} AS prop_change FROM shares"""
)
def change_stats_from_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistic and step recovered from wide column names such as ``prop_feb_mar``."""
    shares = change.month_change_share(season_of(spark, sf_dir, YEAR))
    steps = {s: s for s in MONTH_STEPS}
    numbers = shares.withColumn("traj_", F.col("count_change").cast("double"))
    wide = widen_many(numbers.withColumnsRenamed({"prop_change": "prop", "traj_": "count"}), ["traj"], "step", ["count", "prop"], steps)
    long = split_stat_name(lengthen(wide, ["traj"], "stat_step", "change"), "stat_step", {"prop": "prop_change", "count": "count_change"})
    return widen(long, ["traj", "step"], "stat", "change", {"count_change": "count_change", "prop_change": "prop_change"})


@register(
    _SEASON
    + """
, pairs AS (
  SELECT traj, mm AS month, CAST(sum(CASE WHEN year = '1999' THEN n ELSE 0 END) AS BIGINT) AS b,
         CAST(sum(CASE WHEN year = '2000' THEN n ELSE 0 END) AS BIGINT) AS c
  FROM labelled WHERE year IN ('1999', '2000') GROUP BY traj, mm
)
, size AS (SELECT traj, count(*) AS n_areas FROM area_labels GROUP BY traj)
SELECT p.traj, p.month, CAST(p.month AS INTEGER) - 1 AS month_order, s.n_areas, p.c - p.b AS count_change,
       round(100.0 * (p.c - p.b) / nullif(CAST(p.b AS DOUBLE), 0), 6) AS percent_change,
       round_even(round(100.0 * (p.c - p.b) / s.n_areas, 7), 0) / 100 + 0.0 AS av_change
FROM pairs p JOIN size s ON s.traj = p.traj"""
)
def yoy_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    season = season_of(spark, sf_dir, BASE, YEAR)
    out = change.year_on_year(season, views.fixed_labels(spark, sf_dir), BASE, YEAR)
    return out.withColumn("percent_change", F.round("percent_change", 6))


_COMPOSITION = """
, small AS (SELECT category, traj, month, sum(n) AS n FROM labelled WHERE year = '2000' GROUP BY ALL)
, composed AS (
  SELECT category, traj, month, CAST(n AS DOUBLE) / nullif(CAST(sum(n) OVER (PARTITION BY traj, month) AS DOUBLE), 0) AS share
  FROM small
)"""


@register(_SEASON + _COMPOSITION + " SELECT category, traj, month, round(share, 6) AS share FROM composed")
def composition_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, labels = panel_of(spark, sf_dir, YEAR), views.fixed_labels(spark, sf_dir)
    shares = composition(panel, labels, YEAR, views.NON_NOTIFIABLE)
    return shares.select("category", "traj", "month", _six("share")).orderBy("month", "traj", "category")


@register(_SEASON + _COMPOSITION + " SELECT traj, month, round(sum(share), 6) AS total FROM composed GROUP BY traj, month")
def composition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, labels = panel_of(spark, sf_dir, YEAR), views.fixed_labels(spark, sf_dir)
    return share_sums(composition(panel, labels, YEAR, views.NON_NOTIFIABLE)).withColumn("total", F.round("total", 6))


_SIZES = """
, freq AS (SELECT traj, count(*) AS n FROM area_labels GROUP BY traj)
, shared AS (SELECT traj, n, 100.0 * n / sum(n) OVER () AS pct FROM freq)"""


@register(
    using(FIXED_LABELS)
    + _SIZES
    + """
SELECT traj, n, round(pct, 6) AS pct,
       '[' || traj || '] N = ' || format('{:,}', n) || ' (' ||
       CASE WHEN pct >= 2 THEN printf('%.0f', round_even(pct, 0)) ELSE printf('%.1f', round_even(pct, 1)) END || '%)' AS traj_title
FROM shared"""
)
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(views.fixed_labels(spark, sf_dir)).select("traj", "n", _six("pct"), "traj_title")


_TOTALS = """
, totals AS (SELECT area_code, month, year, traj, sum(n) AS n FROM labelled GROUP BY ALL)"""


def frequencies_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.cluster_frequencies(panel_of(spark, sf_dir), views.fixed_labels(spark, sf_dir), views.NON_NOTIFIABLE)


@register(
    _SEASON
    + _TOTALS
    + """
SELECT traj, month, year, monthname(CAST(month || '-01' AS DATE)) AS month_name,
       CAST(median(n) AS DOUBLE) AS median, round(avg(n), 6) AS mean
FROM totals GROUP BY ALL"""
)
def median_mean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.median_mean_lines(frequencies_of(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@register(_SEASON + _TOTALS + " SELECT traj, month, year, round(avg(n), 6) AS centre FROM totals GROUP BY ALL")
def cluster_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.centres(frequencies_of(spark, sf_dir)).withColumn("centre", F.round("centre", 6))


@register(
    _SEASON
    + _TOTALS
    + """
SELECT traj, month, year, round(CAST(quantile_cont(n, 0.25) AS DOUBLE), 6) AS p25,
       round(CAST(quantile_cont(n, 0.75) AS DOUBLE), 6) AS p75, round(CAST(quantile_cont(n, 0.95) AS DOUBLE), 6) AS p95
FROM (SELECT traj, month, year, CAST(n AS DOUBLE) AS n FROM totals) GROUP BY ALL"""
)
def cluster_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = distribution.percentile_table(frequencies_of(spark, sf_dir), {"p25": 0.25, "p75": 0.75, "p95": 0.95})
    return table.select("traj", "month", "year", _six("p25"), _six("p75"), _six("p95"))


GRID_POINTS = 512


@register(
    _SEASON
    + _TOTALS
    + f"""
, vals AS (SELECT traj, month, CAST(n AS DOUBLE) AS n FROM totals WHERE year = '2000')
, shape AS (
  SELECT traj, month, count(*) AS size, min(n) AS lo, max(n) AS hi, stddev_samp(n) AS sd,
         quantile_cont(n, 0.75) - quantile_cont(n, 0.25) AS iqr
  FROM vals GROUP BY ALL HAVING count(*) > 1
)
, width AS (
  SELECT *, 2.0 * 0.9 * power(size, -0.2) * CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34) WHEN sd > 0 THEN sd
                WHEN lo > 0 THEN lo ELSE 1 END AS bw
  FROM shape
)
, grid AS (SELECT w.*, i AS point, lo + (hi - lo) * i / ({GRID_POINTS} - 1.0) AS at FROM width w, range({GRID_POINTS}) r(i))
SELECT g.traj, g.month, CAST(g.point AS INTEGER) AS point, round(g.at, 6) AS at,
       round(sum(v.freq * exp(-power((g.at - v.n) / g.bw, 2) / 2)) / (g.size * g.bw * sqrt(2 * pi())), 6) AS density
FROM grid g JOIN (SELECT traj, month, n, count(*) AS freq FROM vals GROUP BY ALL) v ON v.traj = g.traj AND v.month = g.month
GROUP BY g.traj, g.month, g.point, g.at, g.size, g.bw"""
)
def density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = distribution.density_grid(frequencies_of(spark, sf_dir), YEAR, GRID_POINTS)
    return grid.select("traj", "month", "point", _six("at"), _six("density"))


@register(
    using(PANEL)
    + f"""
, kept AS (
  SELECT *, split_part(month, '-', 2) AS mm FROM panel
  WHERE category NOT IN ('4-NOT SPECIFIED', '5-LOW') AND split_part(month, '-', 2) BETWEEN '02' AND '08' AND year IN ('{BASE}', '{YEAR}')
)
, clustered AS (SELECT area_code FROM kept WHERE year = '{YEAR}' GROUP BY area_code HAVING sum(n) <> 0)
SELECT mm AS month, CAST(sum(n) FILTER (year = '{YEAR}') - sum(n) FILTER (year = '{BASE}') AS BIGINT) AS change
FROM kept WHERE area_code IN (SELECT area_code FROM clustered) GROUP BY mm"""
)
def cluster_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-means labels of the season's trajectories joined to the incident panel; the changes of the clusters between two
    years, added up, are the change of all clustered areas."""
    cells = panel_of(spark, sf_dir, BASE, YEAR).cells
    labels = stage(trajectory_clusters(trajectories(cells, YEAR, views.NON_NOTIFIABLE), 4, restarts=2), "labels")
    season = change.season_counts(cells, labels, (BASE, YEAR), views.NON_NOTIFIABLE).filter("traj IS NOT NULL")
    sign = F.when(F.col("year") == YEAR, F.col("n")).otherwise(-F.col("n"))
    by_cluster = season.groupBy("month", "traj").agg(F.sum(sign).alias("change"))
    return by_cluster.groupBy("month").agg(F.sum("change").alias("change"))
