import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallyward.functions import national_grid, numbers, text


@pytest.mark.parametrize(
    "raw, clean",
    [("LSOA code", "lsoa_code"), ("Crime type", "crime_type"), ("reportedBy", "reported_by"), ("2020 count", "x2020_count"), ("a%", "a_percent")],
)
def test_snake_case(raw, clean):
    assert text.snake_case(raw) == clean


def test_clean_names_numbers_repeats(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["A b", "a B", "c"])
    assert text.clean_names(df).columns == ["a_b", "a_b_2", "c"]


def test_month_parts(spark):
    df = spark.createDataFrame([("2020-02",), ("2002-08",)], ["m"])
    out = df.select(text.year_of(F.col("m")), text.month_of(F.col("m")), text.month_name(F.col("m")), text.from_position(F.col("m"), 6))
    assert rows(out) == [("2002", "08", "August", "08"), ("2020", "02", "February", "02")]


def test_month_name_does_not_match_inside_the_year(spark):
    """02 inside 2020 must not turn every month into February."""
    df = spark.createDataFrame([("2020-07",)], ["m"])
    assert df.select(text.month_name(F.col("m"))).first()[0] == "July"


def test_ordinal_and_recode(spark):
    df = spark.createDataFrame([("b",), ("z",), (None,)], "v string")
    out = df.select("v", text.ordinal(F.col("v"), ["a", "b"]).alias("o"), text.recode(F.col("v"), {"b": "B"}).alias("r"))
    assert rows(out) == [(None, None, None), ("b", 2, "B"), ("z", None, "z")]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (-0.125,)], ["v"])
    assert [r[0] for r in df.select(numbers.half_even(F.col("v"), 2)).collect()] == [0.12, 0.38, -0.12]


def test_zero_divisor_is_null(spark):
    df = spark.createDataFrame([(5, 0), (5, 4)], ["a", "b"])
    out = df.select(numbers.ratio(F.col("a"), F.col("b")), numbers.percent_change(F.col("a"), F.col("b")))
    assert [tuple(r) for r in out.collect()] == [(None, None), (1.25, 25.0)]


def test_percent_label(spark):
    df = spark.createDataFrame([(-15.0,), (7.0,)], ["v"])
    assert [r[0] for r in df.select(text.percent_label(F.col("v"))).collect()] == ["15%", "7%"]


def test_row_sum_propagates_null(spark):
    df = spark.createDataFrame([(1, 2), (1, None)], "a int, b int")
    assert [r[0] for r in df.select(numbers.row_sum(["a", "b"])).collect()] == [3, None]


def test_null_strict_aggregate(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1), ("b", None)], "k string, v int")
    out = df.groupBy("k").agg(numbers.null_strict(F.avg("v"), F.col("v")).alias("m"))
    assert rows(out) == [("a", 2.0), ("b", None)]


def test_round_numeric_leaves_other_columns(spark):
    df = spark.createDataFrame([("a", 2, 1.005, 2.675)], ["k", "n", "x", "y"])
    assert rows(numbers.round_numeric(df)) == [("a", 2, 1.0, 2.68)]


def _degrees(d, m, s):
    return d + m / 60 + s / 3600


def test_projection_of_a_published_point(spark):
    """A published survey point; without a datum grid the shift is good to a few metres."""
    df = spark.createDataFrame([(_degrees(1, 42, 57.8663), _degrees(52, 39, 28.8282))], ["lon", "lat"])
    got = national_grid.project(df).first()
    assert abs(got["easting"] - 651409.804) < 5
    assert abs(got["northing"] - 313177.450) < 5


def test_transverse_mercator_of_a_published_point(spark):
    """The worked example of the grid definition: same datum, so only the series is tested."""
    lat, lon = math.radians(_degrees(52, 39, 27.2531)), math.radians(_degrees(1, 43, 4.5177) + 2)
    df = spark.createDataFrame([((lat, lon),)], "at struct<f:double,d:double>")
    got = df.select(national_grid.transverse_mercator(F.col("at")).alias("g")).first().g
    assert abs(got.east - 651409.903) < 0.01
    assert abs(got.north - 313177.270) < 0.01
