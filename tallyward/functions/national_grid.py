"""Longitude/latitude (WGS84) to British National Grid metres as column expressions.

Published method: geodetic to Cartesian, seven-parameter Helmert shift to the
Airy-based datum, Cartesian back to geodetic by the closed formula, transverse Mercator series.
Accuracy is a few metres, as no datum grid is used.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# Fixed values from the published national grid definition.
WGS84_A = 6378137.0
WGS84_B = 6356752.314245
AIRY_A = 6377563.396
AIRY_B = 6356256.909
SHIFT_X = -446.448
SHIFT_Y = 125.157
SHIFT_Z = -542.060
ROTATE_X_SEC = -0.1502
ROTATE_Y_SEC = -0.2470
ROTATE_Z_SEC = -0.8421
SCALE_PPM = 20.4894
GRID_F0 = 0.9996012717
GRID_LAT0_DEG = 49.0
GRID_LON0_DEG = -2.0
GRID_E0 = 400000.0
GRID_N0 = -100000.0

WGS84_E2 = 1 - (WGS84_B * WGS84_B) / (WGS84_A * WGS84_A)
AIRY_E2 = 1 - (AIRY_B * AIRY_B) / (AIRY_A * AIRY_A)
AIRY_EP2 = (AIRY_A * AIRY_A - AIRY_B * AIRY_B) / (AIRY_B * AIRY_B)
GRID_N = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B)


def _seconds(value: float) -> float:
    return math.radians(value / 3600.0)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it.

    Bound by a lambda, the value stays a single node of the expression; plain columns would be repeated
    at every use as soon as Spark moves a filter or join key below the projection.
    """
    return F.transform(F.array(value), body)[0]


def project(df: DataFrame, lon: str = "lon", lat: str = "lat", easting: str = "easting", northing: str = "northing") -> DataFrame:
    """Add ``easting`` and ``northing`` columns."""
    degrees = F.struct(F.radians(lat).alias("phi"), F.radians(lon).alias("lam"))
    grid = _let(_let(_let(_let(degrees, _cartesian), _shifted), _geodetic), transverse_mercator)
    return df.select("*", grid.alias("_grid")).select(
        *df.columns, F.col("_grid.east").alias(easting), F.col("_grid.north").alias(northing)
    )


def unproject(df: DataFrame, easting: str = "easting", northing: str = "northing", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add longitude and latitude of grid positions: the published series backwards, the shift inverted as a linear map, and the
    closed formula on the other ellipsoid. Undoes ``project`` to well below a millimetre."""
    start = F.struct((F.col(easting) - GRID_E0).alias("e"), (F.col(northing) - GRID_N0).alias("n"))
    steps = (_footpoint, _from_grid, lambda at: _cartesian_on(at, AIRY_A, AIRY_E2), _unshifted, _degrees)
    found = start
    for step in steps:
        found = _let(found, step)
    return df.select("*", found.alias("_degrees")).select(*df.columns, F.col("_degrees.lon").alias(lon), F.col("_degrees.lat").alias(lat))


def _footpoint(at: Column) -> Column:
    """Latitude on the central meridian with the same northing, by the series in the third flattening, and what depends on it."""
    n, arc0 = GRID_N, _arc_number(math.radians(GRID_LAT0_DEG))
    mu = (at["n"] + arc0) / (AIRY_B * GRID_F0 * (1 + n + 1.25 * n**2 + 1.25 * n**3))
    sines = [1.5 * n - 27 / 32 * n**3, 21 / 16 * n**2 - 55 / 32 * n**4, 151 / 96 * n**3, 1097 / 512 * n**4]
    value = _let(mu, lambda m: m + sum((F.sin(2 * (k + 1) * m) * c for k, c in enumerate(sines)), F.lit(0.0)))
    return F.struct(at["e"].alias("e"), value.alias("f"))


def _arc_number(lat: float) -> float:
    """Length of the meridian from the equator, as a number, to the order of ``_meridian_arc``."""
    n = GRID_N
    return (AIRY_B * GRID_F0) * (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * lat
        - (3 * n + 3 * n**2 + 2.625 * n**3) / 2 * math.sin(2 * lat)
        + (1.875 * n**2 + 1.875 * n**3) / 2 * math.sin(4 * lat)
        - (35 / 24 * n**3) / 2 * math.sin(6 * lat)
    )


def _from_grid(at: Column) -> Column:
    """Latitude ``phi`` and longitude ``lam`` on the grid's ellipsoid."""
    w = 1 - AIRY_E2 * F.pow(F.sin(at["f"]), 2)
    v = F.lit(AIRY_A * GRID_F0) / F.sqrt(w)
    terms = F.struct(
        at["f"].alias("f"), F.tan(at["f"]).alias("tan"), F.cos(at["f"]).alias("c"), v.alias("v"), (v * (1 - AIRY_E2) / w).alias("r"),
        (at["e"] / v).alias("q"),
    )

    def series(x: Column) -> Column:
        t, ratio, q = x["tan"] * x["tan"], x["v"] / x["r"], x["q"]
        h, q2 = ratio - 1, q * q
        phi = x["f"] - x["tan"] * ratio * q2 / 2 * (1 - q2 / 12 * (5 + 3 * t + h - 9 * t * h) + q2 * q2 / 360 * (61 + 90 * t + 45 * t * t))
        lam = q / x["c"] * (
            1 - q2 / 6 * (ratio + 2 * t) + q2 * q2 / 120 * (5 + 28 * t + 24 * t * t) - F.pow(q2, 3) / 5040 * (61 + 662 * t + 1320 * t * t + 720 * F.pow(t, 3))
        )
        return F.struct(phi.alias("phi"), (lam + math.radians(GRID_LON0_DEG)).alias("lam"))

    return _let(terms, series)


def _unshifted(at: Column) -> Column:
    """The shift backwards: its matrix inverted."""
    k = 1 + SCALE_PPM * 1e-6
    rx, ry, rz = (_seconds(v) for v in (ROTATE_X_SEC, ROTATE_Y_SEC, ROTATE_Z_SEC))
    back = np.linalg.inv(np.array([[k, -rz, ry], [rz, k, -rx], [-ry, rx, k]]))
    moved = [at["x"] - SHIFT_X, at["y"] - SHIFT_Y, at["z"] - SHIFT_Z]
    return F.struct(*(sum((m * float(c) for m, c in zip(moved, row)), F.lit(0.0)).alias(name) for name, row in zip("xyz", back)))


def _degrees(at: Column) -> Column:
    """Longitude and latitude in degrees of a place on the satellite ellipsoid."""
    e2, ep2 = WGS84_E2, (WGS84_A * WGS84_A - WGS84_B * WGS84_B) / (WGS84_B * WGS84_B)
    away = F.struct(F.sqrt(at["x"] * at["x"] + at["y"] * at["y"]).alias("p"), at["z"].alias("z"), F.atan2(at["y"], at["x"]).alias("lam"))

    def latitude(c: Column) -> Column:
        closed = lambda q: F.atan2(c["z"] + ep2 * WGS84_B * F.pow(F.sin(q), 3), c["p"] - e2 * WGS84_A * F.pow(F.cos(q), 3))
        return F.struct(F.degrees(c["lam"]).alias("lon"), F.degrees(_let(F.atan2(c["z"] * WGS84_A, c["p"] * WGS84_B), closed)).alias("lat"))

    return _let(away, latitude)


def _cartesian(at: Column) -> Column:
    return _cartesian_on(at, WGS84_A, WGS84_E2)


def _cartesian_on(at: Column, a: float, e2: float) -> Column:
    phi, lam = at["phi"], at["lam"]
    nu = F.lit(a) / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    return F.struct(
        (nu * F.cos(phi) * F.cos(lam)).alias("x"),
        (nu * F.cos(phi) * F.sin(lam)).alias("y"),
        ((1 - e2) * nu * F.sin(phi)).alias("z"),
    )


def _shifted(at: Column) -> Column:
    x, y, z = at["x"], at["y"], at["z"]
    k = 1 + SCALE_PPM * 1e-6
    rx, ry, rz = (math.radians(v / 3600.0) for v in (ROTATE_X_SEC, ROTATE_Y_SEC, ROTATE_Z_SEC))
    return F.struct(
        (SHIFT_X + k * x - rz * y + ry * z).alias("x"),
        (SHIFT_Y + rz * x + k * y - rx * z).alias("y"),
        (SHIFT_Z - ry * x + rx * y + k * z).alias("z"),
    )


def _geodetic(at: Column) -> Column:
    """Latitude by the closed formula; longitude relative to the grid's meridian."""
    away = F.struct(
        F.sqrt(at["x"] * at["x"] + at["y"] * at["y"]).alias("p"),
        at["z"].alias("z"),
        (F.atan2(at["y"], at["x"]) - math.radians(GRID_LON0_DEG)).alias("d"),
    )

    def latitude(c: Column) -> Column:
        angle = F.struct(F.atan2(c["z"] * AIRY_A, c["p"] * AIRY_B).alias("q"), c.alias("c"))
        return _let(
            angle,
            lambda a: F.struct(
                F.atan2(
                    a["c"]["z"] + AIRY_EP2 * AIRY_B * F.pow(F.sin(a["q"]), 3),
                    a["c"]["p"] - AIRY_E2 * AIRY_A * F.pow(F.cos(a["q"]), 3),
                ).alias("f"),
                a["c"]["d"].alias("d"),
            ),
        )

    return _let(away, latitude)


def transverse_mercator(at: Column) -> Column:
    """Grid position of ``struct(f, d)``: latitude, and longitude from the central meridian, in radians."""
    f = at["f"]
    w = 1 - AIRY_E2 * F.pow(F.sin(f), 2)
    v = F.lit(AIRY_A * GRID_F0) / F.sqrt(w)
    terms = F.struct(
        f.alias("f"),
        at["d"].alias("d"),
        F.sin(f).alias("s"),
        F.cos(f).alias("c"),
        F.pow(F.tan(f), 2).alias("t"),
        v.alias("v"),
        (v * (1 - AIRY_E2) / w).alias("r"),
    )
    return _let(terms, _series)


def _series(at: Column) -> Column:
    d, s, c, t, v, r = (at[n] for n in ("d", "s", "c", "t", "v", "r"))
    h = v / r - 1
    c3, c5 = F.pow(c, 3), F.pow(c, 5)
    north = (
        _meridian_arc(at["f"], math.radians(GRID_LAT0_DEG))
        + F.pow(d, 2) * v * s * c / 2
        + F.pow(d, 4) * v * s * c3 * (5 - t + 9 * h) / 24
        + F.pow(d, 6) * v * s * c5 * (61 - 58 * t + t * t) / 720
    )
    east = (
        d * v * c
        + F.pow(d, 3) * v * c3 * (v / r - t) / 6
        + F.pow(d, 5) * v * c5 * (5 - 18 * t + t * t + 14 * h - 58 * t * h) / 120
    )
    return F.struct((GRID_E0 + east).alias("east"), (GRID_N0 + north).alias("north"))


def _meridian_arc(lat: Column, lat0: float) -> Column:
    n = GRID_N
    less, more = lat - lat0, lat + lat0
    return (AIRY_B * GRID_F0) * (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * less
        - (3 * n + 3 * n**2 + 2.625 * n**3) * F.sin(less) * F.cos(more)
        + (1.875 * n**2 + 1.875 * n**3) * F.sin(2 * less) * F.cos(2 * more)
        - (35 / 24 * n**3) * F.sin(3 * less) * F.cos(3 * more)
    )
