"""Counting, zero-filling and frequency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tallyward.operators.rows import bounded, left_match
from tallyward.sources.staging import stage


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Row count per key. Partial counts run before the shuffle, so one hot key costs one row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def level_axes(rows: DataFrame, within: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """Per ``within`` group, the values each level takes, as arrays ``_<level>``; NULL is a value too.

    Levels are vocabularies (categories, months), so the arrays are short.
    """
    return rows.groupBy(*within).agg(*[F.collect_set(F.struct(c)).alias(f"_{c}") for c in levels])


def complete(
    counts: DataFrame, within: Sequence[str], wide: str, narrow: Sequence[str], value: str = "n", axes: DataFrame | None = None
) -> DataFrame:
    """Every combination of the levels that occur inside each ``within`` group; absent ones get 0.

    Rows of ``counts`` with the same key are added up. NULL is a level like any other and an explicit NULL value becomes 0.
    The sparse rows are gathered per (``within``, ``wide``) into a nested map, at most one entry per
    combination of the narrow levels, and the short axes are exploded over it. Only sparse rows are
    shuffled, once; the dense result is produced in place and no product of tables is formed.

    Without ``axes`` the counts are read twice, so they are staged first.
    """
    if axes is None:
        counts = stage(counts, "complete")
        axes = level_axes(counts, within, narrow)
    keys = [*within, wide]
    kind = dict(counts.dtypes)[value]
    rows = counts.groupBy(*keys, *narrow).agg(F.sum(value).cast(kind).alias("_cells")).repartition(*keys)
    for i in reversed(range(len(narrow))):
        entry = F.struct(F.struct(narrow[i]).alias("key"), F.col("_cells").alias("value"))
        rows = rows.groupBy(*keys, *narrow[:i]).agg(F.map_from_entries(F.collect_list(entry)).alias("_cells"))
    out = left_match(rows, bounded(axes, "axes"), {k: k for k in within})
    for i, level in enumerate(narrow):
        out = out.withColumn("_key", F.explode(f"_{level}"))
        out = out.select(
            *keys,
            *narrow[:i],
            F.col(f"_key.{level}").alias(level),
            F.try_element_at("_cells", F.col("_key")).alias("_cells"),
            *[f"_{later}" for later in narrow[i + 1 :]],
        )
    zero = F.lit(0).cast(dict(counts.dtypes)[value])
    return out.select(*keys, *narrow, F.coalesce("_cells", zero).alias(value))


def share_of_total(freq: DataFrame, value: str = "n", name: str = "pct") -> DataFrame:
    """Percent of the grand total, read as a scalar subquery."""
    total = freq.agg(F.sum(value))
    return freq.withColumn(name, F.try_divide(F.lit(100.0) * F.col(value), total.scalar().cast("double")))


def value_frequencies(df: DataFrame, keys: Sequence[str], value: str, freq: str = "freq") -> DataFrame:
    """How often each value occurs per group.

    The shuffle key includes the value, so a group with a third of all rows is merged by many tasks,
    and what is left per group is its number of distinct values.
    """
    return count_by(df, [*keys, value], freq)


def running_ranks(freq: DataFrame, keys: Sequence[str], value: str, count: str = "freq") -> DataFrame:
    """Add ``below``: the number of rows with a smaller value. The window runs over distinct values."""
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return freq.withColumn("below", F.coalesce(F.sum(count).over(w), F.lit(0)))


def exact_quantiles(
    freq: DataFrame, keys: Sequence[str], value: str, at: dict[str, float], count: str = "freq"
) -> DataFrame:
    """Exact quantiles per group from a frequency table, linear between the two neighbouring ranks.

    ``at`` maps output names to probabilities; 0.5 is the usual median. Plain running sums over
    distinct values, which Spark can spill, instead of one value map per group.
    """
    total = F.sum(count).over(Window.partitionBy(*keys))
    ranked = running_ranks(freq, keys, value, count).withColumn("_total", total)
    last = F.col("below") + F.col(count)
    picks = []
    for name, p in at.items():
        place = (F.col("_total") - 1) * F.lit(p)
        low = F.floor(place) + 1
        high = F.least(low + 1, F.col("_total"))
        hit = lambda rank: F.max(F.when((F.col("below") < rank) & (rank <= last), F.col(value)))
        part = F.max(place - F.floor(place))
        picks.append(F.when(part == 0, hit(low)).otherwise(hit(low) * (1 - part) + hit(high) * part).alias(name))
    return ranked.groupBy(*keys).agg(*picks)
