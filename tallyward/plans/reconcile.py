"""Comparing the areas of the incident panel with those of the boundary layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyward.functions.text import first_chars
from tallyward.plans.panel import CountPanel
from tallyward.plans.settings import KEPT_PREFIXES


def analysed_boundaries(boundaries: DataFrame, label_pattern: str, prefixes: Sequence[str] = KEPT_PREFIXES) -> DataFrame:
    """Polygons of the kept countries outside the excluded districts."""
    kept = first_chars(F.col("geo_code"), 1).isin(*prefixes) & ~F.col("geo_label").rlike(label_pattern)
    return boundaries.filter(kept)


def missing_areas(panel: CountPanel, boundaries: DataFrame) -> DataFrame:
    """Per panel year, the boundary areas without a single incident. They are left out, not zero-filled.

    Every boundary row is paired with the few panel years by exploding them, then the (area, year)
    pairs of the panel are taken away.
    """
    years = panel.levels.agg(F.collect_set("year").alias("years")).scalar()
    wanted = boundaries.withColumn("year", F.explode(years))
    seen = panel.cells.select(F.col("area_code").alias("_code"), F.col("year").alias("_year")).distinct()
    same = (wanted["geo_code"] == seen["_code"]) & (wanted["year"] == seen["_year"])
    return wanted.join(seen, same, "left_anti")


def seen_boundaries(panel: CountPanel, boundaries: DataFrame) -> DataFrame:
    """Boundary rows whose area occurs in the panel."""
    codes = panel.cells.select(F.col("area_code").alias("geo_code"))
    return boundaries.join(codes, "geo_code", "left_semi")


def area_counts(panel: CountPanel, boundaries: DataFrame) -> DataFrame:
    """Number of distinct areas in the boundary layer, in its seen part and in each panel year."""

    def size(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count_distinct("geo_code").alias("n_areas")).select(F.lit(name).alias("source"), "n_areas")

    per_year = panel.area_counts().select(F.concat(F.lit("panel_"), "year").alias("source"), "n_areas")
    whole = size(boundaries, "boundaries")
    return whole.unionByName(size(seen_boundaries(panel, boundaries), "boundaries_seen")).unionByName(per_year)
