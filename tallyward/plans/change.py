"""Change between months and between years, attributed to clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tallyward.functions.numbers import half_even, percent_change, ratio
from tallyward.functions.text import month_name, ordinal, percent_label
from tallyward.operators.rows import drop_values, keep_values
from tallyward.plans.settings import MONTH_STEPS, STUDY_MONTHS, study_periods


def label_cells(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts with the cluster of their area. Areas without a label keep NULL."""
    return cells.join(labels.select("area_code", "traj"), "area_code", "left")


def season_counts(cells: DataFrame, labels: DataFrame, years: Sequence[str], non_notifiable: Sequence[str]) -> DataFrame:
    """Notifiable offences per cluster and season month of the given years, zeros included.

    One aggregation with a conditional sum per month gives a row per cluster, unpivoted at the end.
    """
    periods = [p for y in years for p in study_periods(y)]
    kept = drop_values(keep_values(cells, "month", periods), "category", non_notifiable)
    rows = label_cells(kept, labels).select("traj", "month", "n")
    every_cluster = labels.select("traj", F.lit(None).cast("string").alias("month"), F.lit(0).cast("long").alias("n"))
    sums = [F.coalesce(F.sum(F.when(F.col("month") == p, F.col("n"))), F.lit(0).cast("long")).alias(p) for p in periods]
    wide = rows.unionByName(every_cluster.distinct()).groupBy("traj").agg(*sums)
    long = wide.unpivot(["traj"], periods, "period", "n")
    return long.select(
        "traj",
        F.substring("period", 1, 4).alias("year"),
        F.substring("period", 6, 2).alias("month"),
        month_name(F.col("period")).alias("month_name"),
        "n",
    )


def cluster_month_totals(season: DataFrame) -> DataFrame:
    """Counts beside the month's total over all clusters; at most clusters x months rows."""
    total = F.sum("n").over(Window.partitionBy("year", "month"))
    return season.withColumns({"total": total, "month_name": F.lower("month_name")})


def month_change_share(season: DataFrame) -> DataFrame:
    """Month-on-month change per cluster and its share of the summed absolute change of all clusters.

    Stays long: the previous month is a lag inside the cluster, the divisor a sum over the step.
    """
    placed = season.withColumn("position", ordinal(F.col("month"), STUDY_MONTHS))
    previous = F.lag("n").over(Window.partitionBy("traj", "year").orderBy("position"))
    step = F.try_element_at(F.array(*[F.lit(s) for s in MONTH_STEPS]), F.col("position") - 1)
    steps = (
        placed.withColumn("count_change", F.col("n") - previous)
        .filter(F.col("position") > 1)
        .select("traj", "year", step.alias("step"), (F.col("position") - 1).alias("step_order"), "count_change")
    )
    moved = F.sum(F.abs("count_change")).over(Window.partitionBy("year", "step"))
    shared = steps.withColumn("share", ratio(F.col("count_change"), moved))
    prop = half_even(F.lit(100.0) * half_even(F.col("share"), 2), 0)
    return shared.withColumns({"prop_change": prop, "prop_label": percent_label(prop)})


def year_on_year(season: DataFrame, labels: DataFrame, base: str, current: str) -> DataFrame:
    """Absolute, percent and per-area change between two years per cluster and month.

    The years meet by key in one aggregation; a base of zero gives a NULL percentage.
    """
    of_year = lambda y: F.sum(F.when(F.col("year") == y, F.col("n")).otherwise(0))
    pairs = season.groupBy("traj", "month").agg(of_year(base).alias("_base"), of_year(current).alias("_current"))
    sizes = labels.groupBy("traj").agg(F.count(F.lit(1)).alias("n_areas"))
    diff = F.col("_current") - F.col("_base")
    return pairs.join(sizes, "traj").select(
        "traj",
        "month",
        ordinal(F.col("month"), STUDY_MONTHS).alias("month_order"),
        "n_areas",
        diff.alias("count_change"),
        percent_change(F.col("_current"), F.col("_base")).alias("percent_change"),
        half_even(ratio(diff, F.col("n_areas")), 2).alias("av_change"),
    )
