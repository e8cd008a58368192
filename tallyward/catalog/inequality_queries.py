"""Generalized Gini series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyward.catalog.panel_queries import panel_of
from tallyward.catalog.registry import register
from tallyward.catalog.sql_views import PANEL, using
from tallyward.plans import inequality
from tallyward.plans.settings import TOTAL_CATEGORY
from tallyward.sources import role_views as views


def _gini_sql(cells: str, keys: str, correction: str = "s.cells") -> str:
    """Direct form: every single cell gets its rank."""
    return f"""
, cells_in AS ({cells})
, ranked AS (SELECT {keys}, n, row_number() OVER (PARTITION BY {keys} ORDER BY n) AS i FROM cells_in)
, s AS (SELECT {keys}, CAST(count(*) AS DOUBLE) AS cells, CAST(sum(n) AS DOUBLE) AS total, CAST(sum(i * n) AS DOUBLE) AS weighted
        FROM ranked GROUP BY {keys})
, coef AS (
  SELECT {keys}, CASE WHEN raw < 0 THEN 0 ELSE raw END AS gini
  FROM (SELECT {keys}, CASE WHEN total > 0 THEN {correction} / nullif({correction} - 1, 0) * (
           greatest(1 / total, 1 / cells) * (2 * weighted / total - cells - 1) - greatest(cells / total, 1) + 1) END AS raw FROM s)
)"""


_BY_CATEGORY = "SELECT category, month, year, n FROM panel"
_CELLS = "SELECT month, year, n FROM panel WHERE category NOT IN ('4-NOT SPECIFIED', '5-LOW')"
_AREAS = """SELECT month, year, area_code, sum(n) AS n FROM panel
  WHERE category NOT IN ('4-NOT SPECIFIED', '5-LOW') GROUP BY month, year, area_code"""


def _six(df: DataFrame) -> DataFrame:
    return df.withColumn("gini", F.round("gini", 6))


@register(
    using(PANEL) + _gini_sql(_BY_CATEGORY, "category, month, year") + " SELECT category, month, year, round(gini, 6) AS gini FROM coef"
)
def gini_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(inequality.gini_by_category(panel_of(spark, sf_dir)))


@register(
    using(PANEL)
    + _gini_sql(_BY_CATEGORY, "category, month, year", "least(cells, total)")
    + " SELECT category, month, year, round(gini, 6) AS gini FROM coef"
)
def gini_by_category_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(inequality.gini_by_category(panel_of(spark, sf_dir), correction="min"))


@register(using(PANEL) + _gini_sql(_CELLS, "month, year") + " SELECT month, year, round(gini, 6) AS gini FROM coef")
def gini_total_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(inequality.gini_total(panel_of(spark, sf_dir), views.NON_NOTIFIABLE, unit="cell"))


@register(using(PANEL) + _gini_sql(_AREAS, "month, year") + " SELECT month, year, round(gini, 6) AS gini FROM coef")
def gini_total_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(inequality.gini_total(panel_of(spark, sf_dir), views.NON_NOTIFIABLE, unit="area"))


@register(
    using(PANEL)
    + _gini_sql(
        f"{_BY_CATEGORY} UNION ALL SELECT '{TOTAL_CATEGORY}' AS category, * FROM ({_CELLS})", "category, month, year"
    )
    + """
SELECT category, year, split_part(month, '-', 2) AS month, round(gini, 6) AS gini FROM coef
WHERE split_part(month, '-', 2) BETWEEN '02' AND '08'"""
)
def inequality_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = panel_of(spark, sf_dir)
    return _six(inequality.inequality_table(panel, views.NON_NOTIFIABLE, TOTAL_CATEGORY))
