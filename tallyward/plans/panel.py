"""The area-month count panel: from raw incidents to counts per category, month, year and area.

The sparse counts are what every analysis reads; the dense, zero-filled form is produced only for
those who ask for it. Zeros needed by medians and inequality follow from the number of areas.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyward.functions.text import first_chars
from tallyward.operators.counts import complete, count_by, level_axes
from tallyward.operators.rows import drop_missing, drop_values, keep_values
from tallyward.sources.files import write_panel
from tallyward.sources.staging import stage

CELL = ["category", "month", "area_code", "year"]


def excluded_areas(boundaries: DataFrame, label_pattern: str, prefix: str) -> DataFrame:
    """Codes of areas served by the excluded providers: by label pattern or by country prefix."""
    code, label = F.col("geo_code"), F.col("geo_label")
    hit = label.rlike(label_pattern) | (first_chars(code, 1) == prefix)
    return boundaries.filter(hit).select("geo_code")


def usable_incidents(incidents: DataFrame, excluded_providers: Sequence[str]) -> DataFrame:
    return drop_missing(drop_values(incidents, "reported_by", excluded_providers), "area_code")


@dataclass(frozen=True)
class CountPanel:
    """Sparse counts of the analysed areas plus the month/category levels seen per year.

    ``cells``: category, month, area_code, year, n (n > 0).
    ``levels``: year, category, month; the full product inside each year, from all usable incidents,
    so a level that occurs only in an excluded area still yields zeros elsewhere.
    """

    cells: DataFrame
    levels: DataFrame

    def save(self, path: str) -> None:
        """Cells by year, so that later reads prune whole years, and levels, below one folder."""
        write_panel(self.cells, f"{path}/cells")
        self.levels.coalesce(1).write.mode("errorifexists").parquet(f"{path}/levels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CountPanel:
        cells = spark.read.schema("category string, month string, area_code string, n bigint, year string").parquet(f"{path}/cells")
        return cls(cells.select(*CELL, "n"), spark.read.parquet(f"{path}/levels"))

    def dense(self) -> DataFrame:
        """All category x month x area combinations of a year, zero-filled."""
        axes = level_axes(self.levels, ["year"], ["category", "month"])
        return complete(self.cells, ["year"], "area_code", ["category", "month"], axes=axes)

    def area_counts(self) -> DataFrame:
        """Number of analysed areas per year."""
        return self.cells.groupBy("year").agg(F.count_distinct("area_code").alias("n_areas"))

    def monthly(self) -> DataFrame:
        """Counts per category, month and year; zero rows of the levels included."""
        keys = ["category", "month", "year"]
        zeros = self.levels.select(*keys, F.lit(0).cast("long").alias("n"))
        return self.cells.select(*keys, "n").unionByName(zeros).groupBy(*keys).agg(F.sum("n").alias("n"))


def build_panel(
    incidents: DataFrame,
    boundaries: DataFrame,
    excluded_providers: Sequence[str],
    label_pattern: str,
    prefix: str,
    years: Sequence[str] | None = None,
) -> CountPanel:
    """Scan the incidents once, stage the sparse counts, and derive the rest from them.

    Levels and seen areas are those of a year, so an analysis of some ``years`` needs no others: they are left out
    before anything is counted.

    The excluded areas are marked in the same pass, so no consumer joins with the boundaries again. Rows are
    sorted inside each file, which lets later month and year filters skip row groups.
    """
    wanted = incidents if years is None else keep_values(incidents, "year", years)
    counts = count_by(usable_incidents(wanted, excluded_providers), CELL)
    return panel_of_counts(counts, boundaries, label_pattern, prefix)


def panel_of_counts(counts: DataFrame, boundaries: DataFrame, label_pattern: str, prefix: str) -> CountPanel:
    """The panel of usable counts, one row a cell: excluded areas are marked, the rows staged once."""
    gone = excluded_areas(boundaries, label_pattern, prefix).distinct().withColumn("_gone", F.lit(True))
    marked = counts.join(gone, counts["area_code"] == gone["geo_code"], "left").select(
        *CELL, "n", F.col("_gone").isNull().alias("kept")
    )
    staged = stage(marked.sortWithinPartitions("year", "month", "category"), "cells")
    axes = level_axes(staged, ["year"], ["category", "month"])
    levels = (
        axes.select("year", F.explode("_category").alias("_c"), "_month")
        .select("year", F.col("_c.category").alias("category"), F.explode("_month").alias("_m"))
        .select("year", "category", F.col("_m.month").alias("month"))
    )
    return CountPanel(cells=staged.filter("kept").drop("kept"), levels=levels)


def dense_counts(incidents: DataFrame) -> DataFrame:
    """Zero-filled counts per year with no area excluded."""
    return complete(count_by(drop_missing(incidents, "area_code"), CELL), ["year"], "area_code", ["category", "month"])
