"""Area trajectories over the study season and labels derived from cluster sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyward.functions.numbers import half_even, row_sum
from tallyward.operators.clustering import assign, calinski_harabasz, fit_restarts, principal_components
from tallyward.operators.counts import count_by, share_of_total
from tallyward.operators.reshape import lengthen, widen
from tallyward.operators.rows import bounded, drop_values, keep_values
from tallyward.plans.settings import MONTH_NAMES, study_periods
from tallyward.sources.files import union_all
from tallyward.sources.staging import stage


def trajectory_table(cells: DataFrame, year: str, non_notifiable: Sequence[str]) -> DataFrame:
    """One row per area with seven monthly totals; areas without any incident in the season drop out.

    Reads the sparse counts: month and category filters reach the scan, and an absent cell is 0 in the
    wide row, so the dense panel is not needed.
    """
    periods = study_periods(year)
    season = drop_values(keep_values(cells, "month", periods), "category", non_notifiable)
    wide = widen(season, ["area_code"], "month", "n", dict(zip(periods, MONTH_NAMES)))
    return wide.na.fill(0, list(MONTH_NAMES)).filter(row_sum(MONTH_NAMES) != 0)


def long_trajectories(wide: DataFrame) -> DataFrame:
    return lengthen(wide, ["area_code"], "month_name", "n")


def cluster_sizes(labels: DataFrame, label: str = "traj") -> DataFrame:
    """Frequency table of the labels with percent of all areas and a printable title."""
    sized = share_of_total(count_by(labels, [label]))
    return sized.withColumn("traj_title", title_of(F.col(label), F.col("n"), F.col("pct")))


def title_of(label: Column, n: Column, pct: Column) -> Column:
    """``[A] N = 19,162 (58%)``; small shares keep one or two decimals."""
    digits = (
        F.when(pct >= 2, F.format_string("%.0f", half_even(pct, 0)))
        .when(pct >= 0.1, F.format_string("%.1f", half_even(pct, 1)))
        .otherwise(F.format_string("%.2f", half_even(pct, 2)))
    )
    return F.format_string("[%s] N = %s (%s%%)", label, F.format_number(n, 0), digits)


def titled_labels(labels: DataFrame, label: str = "traj") -> DataFrame:
    """Labels with their title. Few titles are sent to the labels: the largest cluster may hold most areas and must not
    be gathered by its letter."""
    titles = cluster_sizes(labels, label).select(label, "traj_title")
    return labels.join(bounded(titles, "titles"), label)


def letters_by_size(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Cluster id -> letters A, B, ..., Z, AA, AB, ...; the largest cluster being A; equal sizes go by cluster id.

    The ranking window sees one row per cluster.
    """
    sizes = count_by(assigned, [cluster])
    rank = F.row_number().over(Window.orderBy(F.desc("n"), F.asc(cluster)))
    place = rank - 1
    letter = lambda n: F.char(F.lit(65) + F.floor(n) % 26)
    one, two = letter(place), F.concat(letter((place - 26) / 26), letter(place))
    three = F.concat(letter((place - 702) / 676), letter((place - 702) / 26), letter(place - 702))
    return sizes.select(cluster, F.when(place < 26, one).when(place < 702, two).otherwise(three).alias("traj"))


def trajectory_clusters(wide: DataFrame, k: int, restarts: int = 20, seed: int = 1612) -> DataFrame:
    """area_code, traj, traj_title: the best of ``restarts`` k-means runs, letters by size."""
    wide = stage(wide, "trajectories")
    best = fit_restarts(wide, MONTH_NAMES, [k], restarts, seed)[k]
    assigned = stage(assign(wide, MONTH_NAMES, best.centres).select("area_code", "cluster"), "assigned")
    labels = assigned.join(bounded(letters_by_size(assigned), "letters"), "cluster").select("area_code", "traj")
    return titled_labels(labels)


def score_candidates(wide: DataFrame, ks: Sequence[int], restarts: int = 20, seed: int = 1612) -> DataFrame:
    """Cost and Calinski-Harabasz score per number of clusters; the highest score is the choice."""
    wide = stage(wide, "trajectories")
    fits = fit_restarts(wide, MONTH_NAMES, ks, restarts, seed)
    placed = [
        assign(wide, MONTH_NAMES, f.centres).select(F.lit(k).alias("candidate"), F.lit(f.cost).alias("cost"), "cluster", *MONTH_NAMES)
        for k, f in fits.items()
    ]
    return calinski_harabasz(union_all(placed), MONTH_NAMES, "cluster", ["candidate", "cost"]).select("candidate", "cost", "ch")


def component_scores(wide: DataFrame, labels: DataFrame) -> DataFrame:
    """PCA scores of every area beside its cluster."""
    return principal_components(wide, "area_code", MONTH_NAMES).scores.join(labels, "area_code")
