"""Distinct counts by sketches: one small sketch for each month and prefix, merged for any set of months.

An exact distinct count of a season reads all cells of its months again. A HyperLogLog sketch keeps what is needed of a month
in at most some 16 kB, and sketches of several months, panels or commits are merged without the rows. Estimates of few
values are exact; of many the standard error is ``STANDARD_ERROR`` of the count, and ``BOUND`` is three times that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyward.functions.text import first_chars
from tallyward.operators.rows import keep_values
from tallyward.plans.panel import CountPanel

LOG_REGISTERS = 14
STANDARD_ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2)
BOUND = 3 * STANDARD_ERROR
KEYS = ["year", "month", "prefix"]


def sketch_distinct(rows: DataFrame, keys: Sequence[str], value: str, name: str = "sketch") -> DataFrame:
    """A sketch of the distinct values of each group. NULL is no value; a group of NULLs has an empty sketch.

    Partial sketches are made before the shuffle, so a hot group is one sketch a task.
    """
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, F.lit(LOG_REGISTERS)).alias(name))


def merge_distinct(sketches: DataFrame, keys: Sequence[str], name: str = "sketch") -> DataFrame:
    """Sketches merged per group; repeated ones change nothing."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg(name).alias(name))


def estimate(sketches: DataFrame, keys: Sequence[str], name: str = "sketch", count: str = "n_distinct") -> DataFrame:
    """The estimated number of distinct values per group, over all sketches of the group."""
    return merge_distinct(sketches, keys, name).select(*keys, F.hll_sketch_estimate(name).alias(count))


def within_bound(estimated: Column, exact: Column) -> Column:
    """Whether an estimate is as close as three standard errors, or one value, allow."""
    return F.abs(estimated - exact) <= F.greatest(F.lit(1.0), exact * F.lit(BOUND))


def area_sketches(panel: CountPanel) -> DataFrame:
    """``year``, ``month``, ``prefix`` and the sketch of the areas with incidents."""
    return sketch_distinct(panel.cells.withColumn("prefix", first_chars(F.col("area_code"), 1)), KEYS, "area_code")


def save_area_sketches(panel: CountPanel, path: str) -> None:
    """Beside the saved panel; a row for each month and prefix."""
    area_sketches(panel).coalesce(1).write.mode("errorifexists").parquet(f"{path}/sketches")


def load_area_sketches(spark: SparkSession, path: str, months: Sequence[str] | None = None) -> DataFrame:
    """The sketches of a saved panel, of some ``months`` (as ``2020-02``) or all. No cell is read."""
    found = spark.read.schema("year string, month string, prefix string, sketch binary").parquet(f"{path}/sketches")
    return found if months is None else keep_values(found, "month", months)
