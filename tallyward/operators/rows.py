"""Row selection, null-safe joins and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from tallyward.sources.staging import stage

MOST_SENT = 10_000


def drop_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Keep rows whose value differs from all ``values``; NULL rows go, as in SQL."""
    if not values:
        return df
    return df.filter(~F.col(column).isin(*values))


def keep_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isin(*values))


def keep_missing(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.na.drop(subset=[column])


def match_pattern(df: DataFrame, column: str, pattern: str, negate: bool = False) -> DataFrame:
    """Unanchored, case-sensitive regular expression filter."""
    hit = F.col(column).rlike(pattern)
    return df.filter(~hit if negate else hit)


def _pairs(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    return reduce(and_, [left[a].eqNullSafe(right[b]) for a, b in keys.items()])


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """Rows whose value is absent from another table's column.

    NULL counts as an ordinary value: it is kept unless the other column holds a NULL.
    The set never leaves the cluster; Spark picks broadcast or shuffle from its size.
    """
    keys = other.select(F.col(other_column).alias("_absent_key"))
    return df.join(keys, df[column].eqNullSafe(keys["_absent_key"]), "left_anti")


def bounded(side: DataFrame, label: str, most: int = MOST_SENT) -> DataFrame:
    """``side`` staged, and sent to all tasks if it has at most ``most`` rows; else joins shuffle as usual.

    For sides with a row for each of few groups: their estimate follows their input, and a shuffle of the other
    side on so few keys would end in as few tasks.
    """
    staged = stage(side, label)
    return F.broadcast(staged) if staged.count() <= most else staged


def left_match(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Left join in which NULL keys match NULL keys; the right key columns are dropped."""
    renamed = right.withColumnsRenamed({b: f"_r_{b}" for b in keys.values()})
    on = _pairs(left, renamed, {a: f"_r_{b}" for a, b in keys.items()})
    return left.join(renamed, on, "left").drop(*[f"_r_{b}" for b in keys.values()])


def right_match(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Right join: every row of ``right`` survives, under the left key names."""
    renamed = left.withColumnsRenamed({a: f"_l_{a}" for a in keys})
    on = _pairs(renamed, right, {f"_l_{a}": b for a, b in keys.items()})
    joined = renamed.join(right, on, "right").drop(*[f"_l_{a}" for a in keys])
    return joined.withColumnsRenamed({b: a for a, b in keys.items()})


def top_per_group(df: DataFrame, group: Sequence[str], measure: str, key: str) -> DataFrame:
    """The row key with the largest measure per group; equal measures resolve to the smallest key, NULL comes last."""
    best = F.min_by(F.struct(F.col(key), F.col(measure)), F.struct(F.col(measure).isNull(), -F.col(measure), F.col(key)))
    return (
        df.groupBy(*group)
        .agg(best.alias("_best"))
        .select(*group, F.col(f"_best.{key}").alias(key), F.col(f"_best.{measure}").alias(measure))
    )


def flag_group_maximum(df: DataFrame, group: str, flags: dict[str, str]) -> DataFrame:
    """0/1 flag per measure for rows equal to their group's maximum; ties are all flagged.

    The maxima are one small row per group joined back, so a group of any size stays spread
    over its partitions instead of being sorted in one window task.
    """
    maxima = df.groupBy(group).agg(*[F.max(m).alias(f"_max_{flag}") for flag, m in flags.items()])
    joined = left_match(df, bounded(maxima, "maxima"), {group: group})
    return joined.withColumns(
        {flag: (F.col(m) == F.col(f"_max_{flag}")).cast("int") for flag, m in flags.items()}
    ).drop(*[f"_max_{flag}" for flag in flags])
