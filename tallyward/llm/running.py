"""Running totals over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyward.sources.staging import stage

RANGES = 64


def running_totals(rows: DataFrame, order: list[Column], totals: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """Each row with, per name in ``totals``, the sum of that expression over all rows before it.

    ``order`` must be a total order. The rows are cut into ranges, each range is summed in its own task, and the
    sums of whole ranges (one row a range) are added to the running sums within ranges. The ranges are written
    once, so both steps see the same cut. An empty table gives an empty result.
    """
    cut = stage(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("_range").agg(*(F.sum(e).alias(f"_sum_{n}") for n, e in totals.items()))
    starts = sums.select("_range", *(F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in totals))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(starts, "_range")
    found = joined.withColumns({n: F.col(f"_start_{n}") + F.coalesce(F.sum(e).over(within), F.lit(0)) for n, e in totals.items()})
    return found.drop("_range", *(f"_start_{n}" for n in totals))
