"""Data-quality report: one row per check."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallyward.operators.rows import bounded
from tallyward.operators.ring_nesting import ring_validity
from tallyward.plans.facilities import places_per_tag
from tallyward.plans.panel import CountPanel


def missing_values(incidents: DataFrame, columns: Sequence[str] = ("month", "category", "area_code")) -> DataFrame:
    """NULLs per column and year, and how far a missing area goes with missing coordinates; one pass."""
    no_area = F.col("area_code").isNull()
    count = lambda cond: F.sum(cond.cast("long"))
    checks = {f"missing_{c}": count(F.col(c).isNull()) for c in columns}
    checks["missing_area_and_x"] = count(no_area & F.col("x").isNull())
    checks["missing_area_and_y"] = count(no_area & F.col("y").isNull())
    wide = incidents.groupBy("year").agg(*[v.alias(k) for k, v in checks.items()])
    return wide.unpivot(["year"], list(checks), "check", "value").select("check", F.col("year").alias("detail"), "value")


def area_checks(panel: CountPanel) -> DataFrame:
    """Distinct areas per year and areas per country prefix."""
    areas = panel.cells.select("year", "area_code").distinct()
    per_year = areas.groupBy("year").agg(F.count(F.lit(1)).alias("value"))
    per_prefix = areas.groupBy("year", F.substring("area_code", 1, 1).alias("p")).agg(F.count(F.lit(1)).alias("value"))
    return per_year.select(F.lit("areas").alias("check"), F.col("year").alias("detail"), "value").unionByName(
        per_prefix.select(F.lit("areas_by_prefix").alias("check"), F.concat_ws(":", "year", "p").alias("detail"), "value")
    )


def boundary_checks(boundaries: DataFrame) -> DataFrame:
    """Valid and invalid polygons."""
    flags = ring_validity(boundaries).groupBy("valid").agg(F.count(F.lit(1)).alias("value"))
    return flags.select(F.lit("boundary_valid").alias("check"), F.col("valid").cast("string").alias("detail"), "value")


def panel_totals(panel: CountPanel) -> DataFrame:
    """Counted incidents per year."""
    totals = panel.cells.groupBy("year").agg(F.sum("n").alias("value"))
    return totals.select(F.lit("panel_total").alias("check"), F.col("year").alias("detail"), "value")


def boundaries_against_panel(panel: CountPanel, boundaries: DataFrame) -> DataFrame:
    """Per year, how many boundary areas the panel lacks and how many of its areas have no boundary."""
    years = bounded(panel.cells.select("year").distinct(), "years")
    codes = boundaries.select(F.col("geo_code").alias("area_code"), F.lit(1).alias("drawn")).distinct()
    seen = panel.cells.select("year", "area_code").distinct()
    per_year = seen.groupBy("year").agg(F.count(F.lit(1)).alias("areas"))
    met = seen.join(codes, "area_code").groupBy("year").agg(F.count(F.lit(1)).alias("both"))
    sides = years.join(per_year, "year").join(met, "year", "left").withColumn("drawn", codes.agg(F.count(F.lit(1))).scalar())
    both = F.coalesce(F.col("both"), F.lit(0))
    rows = sides.withColumns({"boundary_without_panel": F.col("drawn") - both, "panel_without_boundary": F.col("areas") - both})
    long = rows.unpivot(["year"], ["boundary_without_panel", "panel_without_boundary"], "check", "value")
    return long.select("check", F.col("year").alias("detail"), "value")


def repeated_points(points: DataFrame) -> DataFrame:
    """Points that repeat a place of their tag, per tag."""
    found = places_per_tag(points)
    return found.select(F.lit("point_repeats").alias("check"), F.concat_ws("=", "key", "value").alias("detail"), F.col("n_repeats").alias("value"))


def quality_report(incidents: DataFrame, panel: CountPanel, boundaries: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """All checks; those of the points only if they are given."""
    parts = [missing_values(incidents), area_checks(panel), panel_totals(panel), boundaries_against_panel(panel, boundaries), boundary_checks(boundaries)]
    return reduce(DataFrame.unionByName, parts if points is None else [*parts, repeated_points(points)])
