"""Long <-> wide with fixed value lists, so that schemas never depend on the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyward.functions.text import month_of, year_of


def widen(df: DataFrame, ids: Sequence[str], names: str, value: str, mapping: dict[str, str]) -> DataFrame:
    """One column per listed name, renamed through ``mapping``; cells are summed."""
    wide = df.groupBy(*ids).pivot(names, list(mapping)).agg(F.sum(value))
    return wide.withColumnsRenamed({k: v for k, v in mapping.items() if k != v})


def widen_many(df: DataFrame, ids: Sequence[str], names: str, values: Sequence[str], mapping: dict[str, str]) -> DataFrame:
    """Several value columns at once, named ``<value>_<name>``."""
    wide = df.groupBy(*ids).pivot(names, list(mapping)).agg(*[F.sum(v).alias(v) for v in values])
    return wide.withColumnsRenamed({f"{k}_{v}": f"{v}_{new}" for k, new in mapping.items() for v in values})


def lengthen(df: DataFrame, ids: Sequence[str], names: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), [c for c in df.columns if c not in ids], names, value)


def split_period(df: DataFrame, period: str = "month") -> DataFrame:
    """Replace ``YYYY-MM`` by two strings; an existing ``year`` column is overwritten."""
    return df.withColumns({"year": year_of(F.col(period)), "month": month_of(F.col(period))})


def split_stat_name(df: DataFrame, column: str, stats: dict[str, str]) -> DataFrame:
    """Take ``<prefix>_<from>_<to>`` names apart into ``stat`` and ``step``."""
    prefix = F.substring_index(column, "_", 1)
    stat = F.coalesce(*[F.when(prefix == p, F.lit(name)) for p, name in stats.items()])
    return df.withColumns({"stat": stat, "step": F.substring(F.col(column), F.length(prefix) + 2, F.length(column))})


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]
