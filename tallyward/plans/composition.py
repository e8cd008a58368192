"""What kinds of incidents make up each cluster's monthly count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tallyward.functions.numbers import ratio
from tallyward.operators.rows import drop_values, keep_values
from tallyward.plans.change import label_cells
from tallyward.plans.panel import CountPanel
from tallyward.plans.settings import study_periods


def composition(panel: CountPanel, labels: DataFrame, year: str, non_notifiable: Sequence[str]) -> DataFrame:
    """Share of each category in the cluster's count of the month; categories without a case have share 0.

    Rows are first summed to category x cluster x month, so the window sees that small table only.
    """
    season = lambda df: drop_values(keep_values(df, "month", study_periods(year)), "category", non_notifiable)
    clusters = labels.agg(F.collect_set(F.struct("traj"))).scalar()
    zeros = season(panel.levels).filter(F.col("year") == year).select(
        "category", F.explode(clusters).alias("_t"), "month", F.lit(0).cast("long").alias("n")
    )
    rows = label_cells(season(panel.cells), labels).select("category", "traj", "month", "n")
    small = (
        rows.unionByName(zeros.withColumn("traj", F.col("_t.traj")).drop("_t"))
        .groupBy("category", "traj", "month")
        .agg(F.sum("n").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("traj", "month"))
    return small.select("category", "traj", "month", ratio(F.col("n"), total).alias("share"))


def share_sums(shares: DataFrame) -> DataFrame:
    """The shares of every cluster and month added up; each should be 1."""
    return shares.groupBy("traj", "month").agg(F.sum("share").alias("total"))
