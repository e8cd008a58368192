"""Generalized, bias-corrected Gini coefficient of counts, from value frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyward.operators.counts import running_ranks

CORRECTIONS = ("n", "min", "none")


def gini_from_frequencies(
    freq: DataFrame,
    keys: Sequence[str],
    value: str = "n",
    count: str = "freq",
    generalized: bool = True,
    correction: str = "n",
    name: str = "gini",
) -> DataFrame:
    """Gini per group from ``(keys, value, frequency)`` rows.

    A block of ``f`` equal values ``v`` with ``b`` smaller ones holds the ranks ``b+1 .. b+f``, so it adds
    ``v * f * (2b + f + 1) / 2`` to the rank-weighted sum. The generalized form scales by
    ``max(1/total, 1/cells)``, so that fewer incidents than cells do not count as inequality in themselves.
    ``correction``: ``"n"`` multiplies by n/(n-1), ``"min"`` by m/(m-1) with m = min(cells, total), ``"none"``
    leaves the value. A group without incidents has no coefficient (NULL).
    """
    if correction not in CORRECTIONS:
        raise ValueError(f"correction must be one of {CORRECTIONS}")
    ranked = running_ranks(freq, keys, value, count)
    v, f, b = F.col(value), F.col(count), F.col("below")
    sums = ranked.groupBy(*keys).agg(
        F.sum(f).cast("double").alias("_cells"),
        F.sum(v * f).cast("double").alias("_total"),
        F.sum((v * f).cast("double") * (2 * b + f + 1) / 2).alias("_weighted"),
    )
    cells, total, weighted = F.col("_cells"), F.col("_total"), F.col("_weighted")
    spread = F.try_divide(2 * weighted, total) - cells - 1
    if generalized:
        raw = F.greatest(F.try_divide(F.lit(1.0), total), 1 / cells) * spread - F.greatest(F.try_divide(cells, total), F.lit(1.0)) + 1
    else:
        raw = spread / cells
    size = {"n": cells, "min": F.least(cells, total), "none": None}[correction]
    if size is not None:
        raw = raw * F.try_divide(size, size - 1)
    value_or_null = F.when(total > 0, F.when(raw < 0, 0.0).otherwise(raw))
    return sums.select(*keys, value_or_null.alias(name))
