"""Numeric expressions with the rounding, division and NULL rules of the analysis."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL for a zero divisor (ANSI mode would raise)."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(numerator: Column, denominator: Column) -> Column:
    return ratio(F.lit(100.0) * numerator, denominator)


def percent_change(new: Column, old: Column) -> Column:
    return ratio(F.lit(100.0) * (new - old), old)


def half_even(col: Column, digits: int = 2) -> Column:
    return F.bround(col, digits)


def row_sum(names: Iterable[str]) -> Column:
    """Sum across columns of one row; NULL if any of them is NULL."""
    return reduce(add, [F.col(c) for c in names])


def positive_flag(col: Column) -> Column:
    return (col > 0).cast("int")


def null_strict(aggregate: Column, over: Column) -> Column:
    """Make an aggregate NULL as soon as one input is NULL."""
    return F.when(F.count(over) == F.count(F.lit(1)), aggregate)


def round_numeric(df: DataFrame, digits: int = 2, skip: Iterable[str] = ()) -> DataFrame:
    """Half-even rounding of every float column; integers are already round."""
    held = set(skip)
    return df.select(
        *[
            half_even(F.col(c), digits).alias(c) if t in ("double", "float") and c not in held else F.col(c)
            for c, t in df.dtypes
        ]
    )
