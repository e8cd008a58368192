"""Generalized Gini series over categories, months and years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyward.operators.counts import value_frequencies
from tallyward.operators.gini import gini_from_frequencies
from tallyward.operators.reshape import split_period
from tallyward.operators.rows import drop_values
from tallyward.plans.panel import CountPanel
from tallyward.plans.settings import STUDY_MONTHS

UNITS = ("cell", "area")


def _with_zero_block(freq: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the cells that are zero: all cells of the group minus those with a count.

    ``groups`` has one row per group with ``n_cells``; a group without counts is all zeros.
    """
    held = freq.select(*keys, F.lit(0).cast("long").alias("n"), (-F.col("freq")).alias("freq"))
    all_cells = groups.select(*keys, F.lit(0).cast("long").alias("n"), F.col("n_cells").alias("freq"))
    zero = held.unionByName(all_cells).groupBy(*keys, "n").agg(F.sum("freq").alias("freq"))
    return freq.unionByName(zero.filter(F.col("freq") > 0))


def gini_by_category(panel: CountPanel, correction: str = "n") -> DataFrame:
    """Coefficient over areas per category, month and year."""
    keys = ["category", "month", "year"]
    freq = value_frequencies(panel.cells, keys, "n")
    groups = panel.levels.join(panel.area_counts().withColumnRenamed("n_areas", "n_cells"), "year")
    return gini_from_frequencies(_with_zero_block(freq, groups, keys), keys, correction=correction)


def gini_total(panel: CountPanel, non_notifiable: Sequence[str], unit: str = "cell", correction: str = "n") -> DataFrame:
    """Coefficient of notifiable offences per month and year.

    ``unit="cell"`` takes every category x area count as one cell; ``"area"`` sums the categories first.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    keys = ["month", "year"]
    cells = drop_values(panel.cells, "category", non_notifiable)
    levels = drop_values(panel.levels, "category", non_notifiable)
    areas = panel.area_counts()
    if unit == "area":
        cells = cells.groupBy("area_code", *keys).agg(F.sum("n").alias("n"))
        groups = levels.select(*keys).distinct().join(areas, "year").withColumnRenamed("n_areas", "n_cells")
    else:
        wide = levels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_categories"))
        groups = wide.join(areas, "year").select(*keys, (F.col("n_areas") * F.col("n_categories")).alias("n_cells"))
    freq = value_frequencies(cells, keys, "n")
    return gini_from_frequencies(_with_zero_block(freq, groups, keys), keys, correction=correction)


def inequality_table(
    panel: CountPanel,
    non_notifiable: Sequence[str],
    total_name: str,
    unit: str = "cell",
    correction: str = "n",
    months: Sequence[str] = STUDY_MONTHS,
) -> DataFrame:
    """Season months of the per-category series with the total as one more category."""
    total = gini_total(panel, non_notifiable, unit, correction).withColumn("category", F.lit(total_name))
    both = split_period(gini_by_category(panel, correction).unionByName(total))
    return both.filter(F.col("month").isin(*months))
