"""String expressions: header clean-up, month parts, labels."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def snake_case(name: str) -> str:
    """``"LSOA code"`` -> ``"lsoa_code"``, ``"reportedBy"`` -> ``"reported_by"``."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.replace("%", "_percent_").replace("#", "_number_"))
    cleaned = re.sub(r"[^0-9A-Za-z]+", "_", spaced).strip("_").lower()
    if not cleaned:
        return "x"
    return f"x{cleaned}" if cleaned[0].isdigit() else cleaned


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column to snake case; repeats get ``_2``, ``_3``, ..."""
    seen: dict[str, int] = {}
    names = []
    for raw in df.columns:
        name = snake_case(raw)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def first_chars(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


def from_position(col: Column, start: int) -> Column:
    """Characters from 1-based ``start`` to the end."""
    return F.substring(col, start, 2_147_483_647)


def month_of(period: Column) -> Column:
    """``"2020-03"`` -> ``"03"``."""
    return F.split(period, "-").getItem(1)


def year_of(period: Column) -> Column:
    """``"2020-03"`` -> ``"2020"``."""
    return F.split(period, "-").getItem(0)


def month_name(period: Column) -> Column:
    """``"2020-03"`` -> ``"March"``; the month is parsed, never matched inside the year."""
    return F.date_format(F.to_date(F.concat(period, F.lit("-01")), "yyyy-MM-dd"), "MMMM")


def ordinal(col: Column, levels: Sequence[str]) -> Column:
    """1-based position of a value in an ordered list of levels; NULL outside the list."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), col)
    return F.when(position > 0, position.cast("int"))


def recode(col: Column, mapping: dict[str, str]) -> Column:
    """Replace listed values, keep the others."""
    out = None
    for old, new in mapping.items():
        out = F.when(col == old, new) if out is None else out.when(col == old, new)
    return col if out is None else out.otherwise(col)


def percent_label(col: Column) -> Column:
    """``-12.0`` -> ``"12%"``: absolute value, no decimals, percent sign."""
    return F.concat(F.abs(col).cast("long").cast("string"), F.lit("%"))
