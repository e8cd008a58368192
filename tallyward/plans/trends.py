"""Trend tables: monthly counts by category and for the total of notifiable offences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyward.functions.text import month_of, ordinal
from tallyward.operators.reshape import split_period
from tallyward.operators.rows import drop_values, keep_values
from tallyward.plans.panel import CountPanel
from tallyward.plans.settings import STUDY_MONTHS


def trend_table(panel: CountPanel, non_notifiable: Sequence[str], total_name: str, months: Sequence[str] = STUDY_MONTHS) -> DataFrame:
    """Counts per category, year and month of the season, with the total as one more category.

    The total leaves out the non-notifiable categories; the detail rows keep them. Both come from the
    same monthly counts: each row is emitted for itself and, if notifiable, for the total.
    """
    monthly = split_period(panel.monthly()).filter(F.col("month").isin(*months))
    total = F.when(~F.col("category").isin(*non_notifiable), F.lit(total_name))
    targets = F.explode(F.array_union(F.array("category"), F.filter(F.array(total), lambda t: t.isNotNull())))
    return (
        monthly.select(targets.alias("category"), "year", "month", "n")
        .groupBy("category", "year", "month")
        .agg(F.sum("n").alias("n"))
        .withColumn("month_order", ordinal(F.col("month"), months))
    )


def long_run_trend(panel: CountPanel, categories: Sequence[str], drop_periods: Sequence[str] = ()) -> DataFrame:
    """Counts of selected categories over all months; ``position`` is the month's place on the time axis."""
    monthly = keep_values(panel.monthly(), "category", categories)
    return _positioned(monthly, ["category"], drop_periods)


def main_measure_trend(panel: CountPanel, non_notifiable: Sequence[str], drop_periods: Sequence[str] = ()) -> DataFrame:
    monthly = drop_values(panel.monthly(), "category", non_notifiable)
    totals = monthly.groupBy("month", "year").agg(F.sum("n").alias("n"))
    return _positioned(totals, [], drop_periods)


def _positioned(monthly: DataFrame, keys: list[str], drop_periods: Sequence[str]) -> DataFrame:
    kept = drop_values(monthly, "month", drop_periods) if drop_periods else monthly
    first = kept.agg(F.min("month").alias("m")).scalar()
    months = lambda c: F.substring(c, 1, 4).cast("int") * 12 + month_of(c).cast("int")
    position = months(F.col("month")) - months(first) + 1
    return kept.select(*keys, "month", "year", "n", position.cast("int").alias("position"))

