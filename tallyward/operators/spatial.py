"""Points and polygons: boxes, ring checks and the grid join, in plain column expressions.

Polygons are ``rings array<array<struct<x,y>>>`` in planar coordinates. Inside means even-odd over all
rings, so holes and parts need no special case; a point on an edge belongs to every polygon it touches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyward.sources.staging import stage

CROWDED_POINTS = 1_000_000
LEVEL_STEP = 64.0
FINEST_LEVEL = -1
CELL_SEGMENTS = 512
TASK_SEGMENTS = 400_000
CELL_CUTS = 8
CUT_DEPTH = 6


def with_box(polygons: DataFrame) -> DataFrame:
    """Add the bounding box columns."""
    xs, ys = F.flatten("rings")["x"], F.flatten("rings")["y"]
    return polygons.withColumns(
        {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}
    )


def with_edges(polygons: DataFrame) -> DataFrame:
    """Replace ``rings`` by an edge list; open rings are closed."""

    def edges_of(ring: Column) -> Column:
        following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))
        return F.zip_with(
            ring,
            following,
            lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
        )

    return polygons.withColumn("edges", F.flatten(F.transform("rings", edges_of))).drop("rings")


def layer_box(polygons: DataFrame) -> DataFrame:
    """One row: bounding box of a whole layer."""
    return with_box(polygons).agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")
    )


@dataclass(frozen=True)
class LayerProfile:
    """Five numbers about a polygon layer: its bounding box and the median extent of its polygons."""

    minx: float
    miny: float
    maxx: float
    maxy: float
    extent: float


def profile_layer(polygons: DataFrame) -> LayerProfile:
    """One aggregation over the layer, fetched as one row.

    As plain numbers the box becomes a filter that the point scan can use, and the extent a literal grid size.
    """
    boxes = with_box(polygons)
    extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    row = boxes.agg(
        F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy"), F.percentile_approx(F.when(extent > 0, extent), 0.5)
    ).first()
    if row[0] is None:
        return LayerProfile(0.0, 0.0, 0.0, 0.0, 1.0)
    return LayerProfile(*row[:4], row[4] or 1.0)


def within_box(points: DataFrame, box: LayerProfile, x: str = "x", y: str = "y") -> DataFrame:
    """Points inside the bounding box of a layer."""
    return points.filter(F.col(x).between(box.minx, box.maxx) & F.col(y).between(box.miny, box.maxy))


def _side(e: Column, x: Column, y: Column) -> Column:
    """Positive if (x, y) lies left of the edge, zero on its line."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])


def _on_edge(e: Column, x: Column, y: Column) -> Column:
    return (
        (_side(e, x, y) == 0)
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def _crosses_ray(e: Column, x: Column, y: Column) -> Column:
    """The ray from the point to the right meets the edge (lower end counts, upper does not)."""
    side = _side(e, x, y)
    upward = (e["y1"] <= y) & (e["y2"] > y) & (side > 0)
    downward = (e["y2"] <= y) & (e["y1"] > y) & (side < 0)
    return upward | downward


def _odd_crossings(edges: Column, x: Column, y: Column) -> Column:
    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != _crosses_ray(e, x, y))


def covers(edges: Column, x: Column, y: Column) -> Column:
    """Inside by even-odd, or on an edge."""
    return F.exists(edges, lambda e: _on_edge(e, x, y)) | _odd_crossings(edges, x, y)


def _level(size: float) -> Column:
    """Grid level of a boxed polygon: cells are ``size`` times a power of ``LEVEL_STEP``, and the polygon at most about
    ``sqrt(LEVEL_STEP)`` cells wide."""
    extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    level = F.floor(F.log(extent / F.lit(size)) / F.lit(math.log(LEVEL_STEP)) + 0.5).cast("int")
    return F.greatest(F.when(extent > 0, level).otherwise(F.lit(0)), F.lit(FINEST_LEVEL))


def _cell_size(size: float, level: int) -> float:
    return size * LEVEL_STEP**level


def levels_of(polygons: DataFrame, size: float) -> list[int]:
    """Grid levels in use; extents that differ by a factor of a million still give no more than five."""
    return sorted(r[0] for r in with_box(polygons.select("rings")).select(_level(size)).distinct().collect())


def grid_cover(polygons: DataFrame, size: float, levels: Sequence[int] = (0,)) -> DataFrame:
    """One row per polygon and grid cell that it reaches, in the grid of the polygon's ``_level``.

    A polygon has some hundred cells at most, however wide. A cell that no edge enters lies wholly inside or outside:
    the outside ones are dropped, the inside ones carry no edges and need no test per point. Other cells keep only the
    edges a test in them can meet: first those of the cell's grid row, then those not wholly to its left.
    """
    cells = with_edges(with_box(polygons)).withColumn("_level", _level(size))
    known = [F.lit(x) for level in levels for x in (level, _cell_size(size, level))]
    cells = cells.withColumn("_size", F.create_map(*known)[F.col("_level")])
    number = lambda v: F.floor(v / F.col("_size"))
    span = lambda lo, hi: F.explode(F.sequence(number(F.col(lo)), number(F.col(hi))))
    # Cells are compared by number, never by their borders: a point's cell is a rounded quotient, and a border
    # computed from a cell number may round the other way.
    in_row = lambda e: F.col("cy").between(number(F.least(e["y1"], e["y2"])), number(F.greatest(e["y1"], e["y2"])))
    cells = cells.withColumn("cy", span("miny", "maxy")).withColumn("edges", F.filter("edges", in_row))
    not_left = lambda e: number(F.greatest(e["x1"], e["x2"])) >= F.col("cx")
    cells = cells.withColumn("cx", span("minx", "maxx")).withColumn("edges", F.filter("edges", not_left))
    entered = F.exists("edges", lambda e: number(F.least(e["x1"], e["x2"])) <= F.col("cx"))
    centre = _odd_crossings(F.col("edges"), (F.col("cx") + 0.5) * F.col("_size"), (F.col("cy") + 0.5) * F.col("_size"))
    kept = cells.withColumn("_entered", entered).filter(F.col("_entered") | centre)
    edges = F.when(F.col("_entered"), F.col("edges"))
    return kept.withColumn("edges", edges).drop("_entered", "_size", "minx", "miny", "maxx", "maxy")


def _place(points: DataFrame, size: float, levels: Sequence[int]) -> DataFrame:
    """Each point with its cell in the grid of each level."""

    def cell(level: int) -> Column:
        number = lambda c: F.floor(F.col(c) / F.lit(_cell_size(size, level)))
        return F.struct(F.lit(level).alias("_level"), number("x").alias("cx"), number("y").alias("cy"))

    return points.withColumn("_cell", F.explode(F.array(*map(cell, levels)))).select(*points.columns, "_cell.*")


def crowded_cells(points: DataFrame, size: float, limit: int = CROWDED_POINTS, levels: Sequence[int] = (0,)) -> DataFrame:
    """Cells with more than ``limit`` points, with the number of parts of at most about ``limit`` to split them into."""
    counts = _place(points.select("x", "y"), size, levels).groupBy("_level", "cx", "cy").agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > limit).select("_level", "cx", "cy", F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))


def match_points(
    points: DataFrame,
    polygons: DataFrame,
    keep: Sequence[str] = ("geo_code",),
    size: float | None = None,
    limit: int = CROWDED_POINTS,
) -> DataFrame:
    """Inner join of points with every polygon that covers them.

    Equi-join on the grid cell, then the exact test. Polygons of very different width lie in grids of different levels,
    and a point goes to its cell of each level in use. In a level it lies in one cell and a polygon lies in one level, so
    no match occurs twice. Crowded cells are known beforehand from a count per cell (``points`` is read twice):
    their points are split by a hash into parts of at most about ``limit`` points, and only there the polygon rows are
    repeated per part. The list of crowded cells has at most a ``limit``-th of the points; it is staged, so Spark knows
    its size and broadcasts it or not.
    """
    size = float(profile_layer(polygons).extent if size is None else size)
    levels = levels_of(polygons, size) or [0]
    crowded = stage(crowded_cells(points, size, limit, levels), "crowded")
    cell = ["_level", "cx", "cy"]
    parts = F.coalesce("_parts", F.lit(1))
    cover = (
        grid_cover(polygons.select(*keep, "rings"), size, levels)
        .join(crowded, cell, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    placed = (
        _place(points, size, levels)
        .join(crowded, cell, "left")
        .withColumn("_part", F.pmod(F.xxhash64(*points.columns), parts).cast("int"))
        .drop("_parts")
    )
    hit = F.col("edges").isNull() | covers(F.col("edges"), F.col("x"), F.col("y"))
    # The size of a file says little about its rows; a side sent to all tasks would be whole in each executor.
    return placed.join(cover.hint("merge"), [*cell, "_part"]).filter(hit).drop("edges", *cell, "_part")


def distinct_points(points: DataFrame, tag: Sequence[str] = ("key", "value")) -> DataFrame:
    """One row per tag and place."""
    return points.select(*tag, "x", "y").distinct()


def ring_segments(polygons: DataFrame, carry: Sequence[str]) -> DataFrame:
    """One row per segment of every ring, numbered without repeated points; ``ring_size`` closes the circle."""
    rings = polygons.select(*carry, F.posexplode("rings").alias("ring_no", "ring"))
    tidy = F.filter("ring", lambda p, i: (i == 0) | (p != F.col("ring")[F.greatest(i - 1, F.lit(0))]))
    rings = rings.withColumn("ring", tidy)
    pairs = F.zip_with(
        F.slice("ring", 1, F.greatest(F.size("ring") - 1, F.lit(0))),
        F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )
    return rings.select(*carry, "ring_no", F.size(pairs).alias("ring_size"), F.posexplode(pairs).alias("seg_no", "s")).select(
        *carry, "ring_no", "ring_size", "seg_no", "s.x1", "s.y1", "s.x2", "s.y2"
    )


SEGMENT_CELL = ["_x0", "_y0", "_g", "_gx", "_gy"]


def _walk(segments: DataFrame, cuts: int | None = None) -> DataFrame:
    """A row for each cell (``_gx``, ``_gy``) that a segment passes in the grid with corner ``_x0``, ``_y0`` and cell
    size ``_g``; with ``cuts`` only for cells of that many rows and columns (and a rim against rounding).

    The rows of the grid first, then in each row the columns between the places where the segment enters and leaves
    it. These places are widened by more than the rounding can shift them, so cells are added but none is left out.
    """
    rim = lambda v, way: v if cuts is None else (F.greatest(v, F.lit(-1)) if way < 0 else F.least(v, F.lit(cuts)))

    def spread(df: DataFrame, name: str, low: Column, high: Column, start: str) -> DataFrame:
        number = lambda v: F.floor((v - F.col(start)) / F.col("_g"))
        ends = df.withColumn("_a", rim(number(low), -1)).withColumn("_b", rim(number(high), 1)).filter("_a <= _b")
        return ends.withColumn(name, F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")

    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    rows = spread(segments, "_gy", F.least(y1, y2), F.greatest(y1, y2), "_y0")
    slack = lambda a, b: F.lit(1e-14) * (F.abs(a) + F.abs(b))
    border = F.col("_y0") + F.col("_gy") * F.col("_g")
    share = lambda y: F.least(F.greatest(F.coalesce(F.try_divide(y - y1, y2 - y1), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    enters, leaves = x1 + share(border - slack(y1, y2)) * (x2 - x1), x1 + share(border + F.col("_g") + slack(y1, y2)) * (x2 - x1)
    level = y1 == y2
    low = F.when(level, F.least(x1, x2)).otherwise(F.least(enters, leaves) - slack(x1, x2))
    high = F.when(level, F.greatest(x1, x2)).otherwise(F.greatest(enters, leaves) + slack(x1, x2))
    return spread(rows, "_gx", low, high, "_x0")


def _contact_rows(placed: DataFrame, code: str) -> DataFrame:
    """Two segments in one cell that meet: ``crossed`` if in a way that rings must not, and the end ``points`` of one that lie
    on the other; ``ring_a``, ``seg_a``, ``ring_b``, ``seg_b``."""
    cell = [code, *SEGMENT_CELL]
    a = placed.select(*cell, F.struct("ring_no", "ring_size", "seg_no", "x1", "y1", "x2", "y2").alias("a"))
    b = a.withColumnRenamed("a", "b")
    gap = F.col("b.seg_no") - F.col("a.seg_no")
    same_ring = F.col("a.ring_no") == F.col("b.ring_no")
    apart = (gap > 1) & (gap < F.col("a.ring_size") - 1)
    later = (F.col("a.ring_no") < F.col("b.ring_no")) | (same_ring & apart)
    met = a.join(b.hint("merge"), cell).filter(later)
    sides = _pair_sides(F.col("a"), F.col("b"))
    proper = (F.signum(sides[0]) * F.signum(sides[1]) < 0) & (F.signum(sides[2]) * F.signum(sides[3]) < 0)
    ends = [(F.col(f"{p}.x{i}"), F.col(f"{p}.y{i}"), F.col(e)) for p, e in ("ba", "ab") for i in (1, 2)]
    on = [F.when(_on_edge(e, x, y), F.struct(x.alias("x"), y.alias("y"))) for x, y, e in ends]
    touch = F.coalesce(*on).isNotNull()
    line = F.lit(True)
    for side in sides:
        line = line & (side == 0)
    stretch = line & (_overlap("x") | _overlap("y"))
    found = met.filter(proper | touch | stretch)
    names = [F.col(f"{p}.{c}_no").alias(f"{c}_{p}") for p in "ab" for c in ("ring", "seg")]
    return found.select(code, (proper | (same_ring & touch) | stretch).alias("crossed"), *names, F.array_compact(F.array(*on)).alias("points"))


def _dealt(segments: DataFrame, cell: Sequence[str], size: int = TASK_SEGMENTS) -> DataFrame:
    """Staged segments by cell, about ``size`` in a task; a given number of tasks is not merged again by their compressed size."""
    tasks = max(segments.sparkSession.sparkContext.defaultParallelism, -(-segments.count() // size))
    return segments.repartition(tasks, *cell)


def _contacts(placed: DataFrame, code: str) -> DataFrame:
    """Codes with two segments in one cell that meet in a way that rings must not."""
    return _contact_rows(placed, code).filter("crossed").select(code).distinct()


def crossing_rings(polygons: DataFrame, code: str = "geo_code", limit: int = CELL_SEGMENTS) -> DataFrame:
    """Codes of polygons with segments that cross (see ``ring_contacts``)."""
    return ring_contacts(polygons, code, limit, _contacts).distinct()


def ring_contacts(polygons: DataFrame, code: str = "geo_code", limit: int = CELL_SEGMENTS, rows_of=_contact_rows) -> DataFrame:
    """What ``rows_of`` finds among the segments of each cell; a pair may come up once a cell.

    Each polygon gets its own grid with about as many cells as segments, and a segment goes to the cells that it passes;
    only segments that share a cell are compared, so even one huge polygon is spread over many keys. Cells with more than
    ``limit`` segments are cut into finer ones, up to ``CUT_DEPTH`` times. Only segments that all pass one spot remain
    together after that. Cells are dealt over as many tasks as their segments ask, ``TASK_SEGMENTS`` for each. Inside a ring, any contact of segments that do not follow each other counts; between rings a true
    crossing or a common stretch does, a common point does not.
    """
    bands = F.ceil(F.sqrt(F.size(F.flatten("rings"))))
    width = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")) / bands
    boxed = with_box(polygons.select(code, "rings")).select(
        code, "rings", F.col("minx").alias("_x0"), F.col("miny").alias("_y0"), F.when(width > 0, width).otherwise(1.0).alias("_g")
    )
    todo = stage(_walk(ring_segments(boxed, [code, "_x0", "_y0", "_g"])), "cell-segments")
    found, cell = [], [code, *SEGMENT_CELL]
    for depth in range(CUT_DEPTH + 1):
        todo = _dealt(todo, cell)
        if depth < CUT_DEPTH:
            hot = stage(todo.groupBy(*cell).count().filter(F.col("count") > limit).select(*cell), "hot-cells")
        if depth == CUT_DEPTH or hot.isEmpty():
            found.append(rows_of(todo, code))
            break
        found.append(rows_of(todo.join(hot, cell, "left_anti"), code))
        corner = lambda c: F.col(f"_{c}0") + F.col(f"_g{c}") * F.col("_g")
        inside = todo.join(hot, cell, "left_semi").withColumns({"_x0": corner("x"), "_y0": corner("y"), "_g": F.col("_g") / CELL_CUTS})
        todo = stage(_walk(inside.drop("_gx", "_gy"), CELL_CUTS), "cell-segments")
    return reduce(DataFrame.union, found)


def _overlap(axis: str) -> Column:
    """Segments ``a`` and ``b`` share more than a point along an axis."""
    ends = {s: (F.col(f"{s}.{axis}1"), F.col(f"{s}.{axis}2")) for s in "ab"}
    return F.greatest(*(F.least(*e) for e in ends.values())) < F.least(*(F.greatest(*e) for e in ends.values()))


def _pair_sides(a: Column, b: Column) -> list[Column]:
    return [_side(a, b["x1"], b["y1"]), _side(a, b["x2"], b["y2"]), _side(b, a["x1"], a["y1"]), _side(b, a["x2"], a["y2"])]
