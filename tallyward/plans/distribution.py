"""How area-month totals are distributed inside each cluster."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyward.functions.text import month_name, month_of
from tallyward.operators.counts import exact_quantiles, value_frequencies
from tallyward.operators.rows import drop_values
from tallyward.plans.change import label_cells
from tallyward.plans.panel import CountPanel
from tallyward.plans.settings import STUDY_MONTHS

GROUP = ["traj", "month", "year"]


def cluster_frequencies(
    panel: CountPanel, labels: DataFrame, non_notifiable: Sequence[str], months: Sequence[str] = STUDY_MONTHS
) -> DataFrame:
    """How many areas of a cluster had n incidents in a month, n = 0 included.

    The zero rows are the cluster's areas in that year minus the areas that had incidents.
    """
    in_season = month_of(F.col("month")).isin(*months)
    season = drop_values(panel.cells.filter(in_season), "category", non_notifiable)
    totals = season.groupBy("area_code", "month", "year").agg(F.sum("n").alias("n"))
    freq = value_frequencies(label_cells(totals, labels), GROUP, "n")

    areas = label_cells(panel.cells.select("area_code", "year").distinct(), labels)
    sizes = areas.groupBy("year", "traj").agg(F.count(F.lit(1)).alias("freq"))
    periods = drop_values(panel.levels.filter(in_season), "category", non_notifiable).select("year", "month").distinct()
    everything = sizes.join(periods, "year").select(*GROUP, F.lit(0).cast("long").alias("n"), "freq")
    held = freq.select(*GROUP, F.lit(0).cast("long").alias("n"), (-F.col("freq")).alias("freq"))
    zeros = everything.unionByName(held).groupBy(*GROUP, "n").agg(F.sum("freq").alias("freq"))
    return freq.unionByName(zeros.filter(F.col("freq") > 0))


def median_mean_lines(freq: DataFrame) -> DataFrame:
    """Median and mean per cluster, month and year."""
    means = freq.groupBy(*GROUP).agg(F.try_divide(F.sum(F.col("n") * F.col("freq")), F.sum("freq")).alias("mean"))
    medians = exact_quantiles(freq, GROUP, "n", {"median": 0.5})
    return medians.join(means, GROUP).withColumn("month_name", month_name(F.col("month")))


def centres(freq: DataFrame) -> DataFrame:
    """Mean trajectory of every cluster: its average count per month."""
    return freq.groupBy(*GROUP).agg((F.sum(F.col("n") * F.col("freq")) / F.sum("freq")).alias("centre"))


def percentile_table(freq: DataFrame, at: dict[str, float]) -> DataFrame:
    return exact_quantiles(freq, GROUP, "n", at)


def density_grid(freq: DataFrame, year: str, points: int = 512, adjust: float = 2.0) -> DataFrame:
    """Gaussian kernel density per cluster and month on an even grid between the extremes.

    Bandwidth: ``adjust * 0.9 * min(sd, IQR/1.34) * n^(-1/5)``, falling back to sd, the smallest value
    and 1 where that is zero. Each distinct value meets the fixed number of grid points, so the work
    depends on how many different counts exist, not on how many areas.
    """
    keys = ["traj", "month"]
    rows = freq.filter(F.col("year") == year).select(*keys, "n", "freq")
    value = F.col("n").cast("double")
    moments = rows.groupBy(*keys).agg(
        F.sum("freq").alias("size"),
        F.sum(value * F.col("freq")).alias("s1"),
        F.sum(value * value * F.col("freq")).alias("s2"),
        F.min("n").alias("lo"),
        F.max("n").alias("hi"),
    )
    quartiles = exact_quantiles(rows, keys, "n", {"q1": 0.25, "q3": 0.75})
    size = F.col("size").cast("double")
    sd = F.sqrt(F.try_divide(F.col("s2") - F.col("s1") * F.col("s1") / size, size - 1))
    shape = moments.join(quartiles, keys).withColumn("sd", sd).filter(F.col("sd").isNotNull())
    narrow = F.least(F.col("sd"), (F.col("q3") - F.col("q1")) / 1.34)
    positive = lambda c: F.when(c > 0, c)
    spread = F.coalesce(positive(narrow), positive(F.col("sd")), positive(F.abs("lo")).cast("double"), F.lit(1.0))
    shape = shape.select(
        *keys, "size", "lo", "hi", (F.lit(adjust * 0.9) * spread * F.pow(size, F.lit(-0.2))).alias("bandwidth")
    )
    grid = F.posexplode(F.sequence(F.lit(0), F.lit(points - 1)))
    spread_out = rows.join(shape, keys).select("*", grid.alias("point", "_i"))
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / F.lit(float(points - 1))
    z = (at - F.col("n")) / F.col("bandwidth")
    weight = F.col("freq") * F.exp(-z * z / 2) / (F.col("size") * F.col("bandwidth") * math.sqrt(2 * math.pi))
    return spread_out.groupBy(*keys, "point", at.alias("at")).agg(F.sum(weight).alias("density"))
