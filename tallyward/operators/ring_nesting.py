"""Validity of polygons and multi-part areas by the topology of their rings.

Segments that cross, overlap, or meet within a ring are found in grid cells (``spatial.ring_contacts``). Rings that meet in single
points are cut there: between two such points a ring lies on one side of each other ring, so one place of each piece
tells where the piece lies. These places meet the segments of the other rings by a join on horizontal bands, and the parity of
the crossings to their right says which rings contain them. A part's interior is in one piece if the graph of its rings and the
points where they touch has no cycle.

Tables of segments, rings and polygons are joined by sorting: by the size of their files, far below that of their rows, Spark would
send some of them whole to every executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyward.operators.graph import components
from tallyward.operators.spatial import CELL_SEGMENTS, _crosses_ray, ring_contacts, ring_segments
from tallyward.sources.staging import stage

BAND_SEGMENTS = 8


def _numbered(polygons: DataFrame, code: str) -> DataFrame:
    """``code``, ``rings`` and ``starts`` (number of the first ring of each part) of polygons with several rings."""
    sizes = F.col("part_sizes") if "part_sizes" in polygons.columns else F.array(F.size("rings"))
    numbers = F.when(F.size(sizes) > 0, F.sequence(F.lit(0), F.size(sizes) - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.transform(numbers, lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda s, n: s + n))
    return polygons.filter(F.size("rings") > 1).select(code, "rings", starts.alias("starts"))


def _part(ring_no: str) -> Column:
    return F.size(F.filter("starts", lambda s: s <= F.col(ring_no)))


def _is_hole(ring_no: str) -> Column:
    return ~F.array_contains("starts", F.col(ring_no))


def _nodes(touches: DataFrame, segments: DataFrame, code: str) -> DataFrame:
    """``ring_no``, ``seg_no``, ``x``, ``y`` of each place where a ring touches another one; an end of a segment is the start of the next."""
    sides = [touches.select(code, F.col(f"ring_{s}").alias("ring_no"), F.col(f"seg_{s}").alias("seg_no"), F.explode("points").alias("p")) for s in "ab"]
    at = sides[0].union(sides[1]).distinct().join(segments.hint("merge"), [code, "ring_no", "seg_no"])
    at_end = (F.col("p.x") == F.col("x2")) & (F.col("p.y") == F.col("y2"))
    seg = F.when(at_end, (F.col("seg_no") + 1) % F.col("ring_size")).otherwise(F.col("seg_no"))
    return at.select(code, "ring_no", seg.alias("seg_no"), "p.x", "p.y").distinct()


def _places(rings: DataFrame, segments: DataFrame, nodes: DataFrame, code: str) -> DataFrame:
    """``ring_no``, ``x``, ``y``: a place on each piece of each ring of ``rings``; an untouched ring is one piece."""
    key = [code, "ring_no"]
    cut = nodes.join(segments.hint("merge"), [*key, "seg_no"])
    along = Window.partitionBy(*key, "seg_no").orderBy(F.pow(F.col("x") - F.col("x1"), 2) + F.pow(F.col("y") - F.col("y1"), 2))
    middle = lambda c: ((F.col(c) + F.coalesce(F.lead(c).over(along), F.col(f"{c}2"))) / 2).alias(c)
    pieces = cut.select(*key, middle("x"), middle("y"))
    alone = segments.filter("seg_no = 0").join(nodes.select(*key).distinct().hint("merge"), key, "left_anti")
    return pieces.union(alone.select(*key, F.col("x1"), F.col("y1"))).join(rings.select(code).hint("merge"), code, "left_semi")


def _containing(places: DataFrame, segments: DataFrame, polygons: DataFrame, code: str) -> DataFrame:
    """``ring_no``, ``x``, ``y``, ``other``: the other rings of the polygon around each place.

    Places and segments meet in bands of a polygon, as many as a ``BAND_SEGMENTS``-th of its segments; a segment goes to the
    bands that it passes. Bands are compared by number on both sides, so rounding loses no meeting.
    """
    ys = F.flatten("rings")["y"]
    bands = F.ceil(F.size(ys) / BAND_SEGMENTS)
    height = (F.array_max(ys) - F.array_min(ys)) / bands
    grid = polygons.select(code, F.array_min(ys).alias("_y0"), F.when(height > 0, height).otherwise(1.0).alias("_h"))
    band = lambda y: F.floor((y - F.col("_y0")) / F.col("_h"))
    spans = F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))
    edge = F.struct("x1", "y1", "x2", "y2").alias("e")
    held = segments.filter("y1 <> y2").join(grid.hint("merge"), code).select(code, F.col("ring_no").alias("other"), edge, F.explode(spans).alias("_band"))
    asked = places.join(grid.hint("merge"), code).select(code, "ring_no", "x", "y", band(F.col("y")).alias("_band"))
    met = asked.join(held.hint("merge"), [code, "_band"]).filter((F.col("ring_no") != F.col("other")) & _crosses_ray(F.col("e"), F.col("x"), F.col("y")))
    crossings = met.groupBy(code, "ring_no", "x", "y", "other").count()
    return crossings.filter(F.col("count") % 2 == 1).drop("count")


def _misplaced(polygons: DataFrame, segments: DataFrame, nodes: DataFrame, code: str) -> DataFrame:
    """``code``, ``stray`` (a hole not inside its shell), ``nested`` (a hole in a hole, a part in a part's interior)."""
    starts = polygons.select(code, "starts").hint("merge")
    places = stage(_places(polygons, segments, nodes, code).distinct(), "ring-places")
    around = _containing(places, segments, polygons, code).join(starts, code)
    around = around.withColumns({"part": _part("ring_no"), "hole": _is_hole("ring_no"), "other_part": _part("other"), "other_hole": _is_hole("other")})
    place = [code, "ring_no", "x", "y"]
    own = (F.col("part") == F.col("other_part")) & ~F.col("other_hole")
    by_part = around.groupBy(*place, "hole", "part", "other_part").agg(F.max(own).alias("own"), F.max("other_hole").alias("in_hole"), F.max(~F.col("other_hole")).alias("in_shell"))
    same = F.col("part") == F.col("other_part")
    nested = F.when(F.col("hole"), same & F.col("in_hole")).otherwise(~same & F.col("in_shell") & ~F.col("in_hole"))
    found = by_part.groupBy(*place).agg(F.max(F.col("own")).alias("own"), F.max(nested).alias("nested"))
    judged = places.join(starts, code).withColumn("hole", _is_hole("ring_no")).join(found.hint("merge"), place, "left")
    stray = F.col("hole") & ~F.coalesce("own", F.lit(False))
    return judged.groupBy(code).agg(F.max(stray).alias("stray"), F.max(F.coalesce("nested", F.lit(False))).alias("nested"))


def _cut_interiors(polygons: DataFrame, touches: DataFrame, code: str) -> DataFrame:
    """Codes of polygons with a part whose rings and touching points make a cycle: as many edges as nodes, or more."""
    pairs = touches.join(polygons.select(code, "starts").hint("merge"), code).withColumns({"part": _part("ring_a"), "part_b": _part("ring_b")})
    pairs = pairs.filter("part = part_b").select(code, "part", F.array("ring_a", "ring_b").alias("rings"), F.explode("points").alias("p"))
    meets = pairs.select(code, "part", F.explode("rings").alias("ring_no"), "p").distinct()
    no_ring, nowhere = F.lit(None).cast("int"), F.lit(None).cast("double")
    ring = F.struct(code, "part", F.col("ring_no").cast("int").alias("ring"), nowhere.alias("x"), nowhere.alias("y"))
    point = F.struct(code, "part", no_ring.alias("ring"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    edges = stage(meets.select(ring.alias("a"), point.alias("b")), "ring-touches")
    if edges.isEmpty():
        return edges.select(F.col(f"a.{code}").alias(code))
    rooted = stage(components(edges), "touch-components")
    n_edges = edges.join(rooted, edges["a"].eqNullSafe(rooted["node"])).groupBy("root").agg(F.count("*").alias("edges"))
    sizes = rooted.groupBy("root").agg(F.count("*").alias("nodes"))
    joined = n_edges.withColumnRenamed("root", "r").join(sizes, F.col("r").eqNullSafe(F.col("root")))
    return joined.filter("edges >= nodes").select(F.col(f"root.{code}").alias(code)).distinct()


def ring_validity(polygons: DataFrame, code: str = "geo_code", limit: int = CELL_SEGMENTS) -> DataFrame:
    """Per polygon: rings closed, at least four points, no crossing or common stretch, holes inside their shell, rings apart (no
    hole in a hole, no part in another's interior), interiors in one piece, and all of it (``valid``).

    The first ring of a part is its shell; ``part_sizes`` has the rings of each part, without it all rings are one part. A
    repeated point is flagged too, but does not make a polygon invalid. What concerns whole rings is judged for polygons
    whose rings are closed and do not cross; of others these flags are true. Rings without points are closed and too short.
    """
    every = lambda test: F.forall("rings", test)

    def no_repeat(ring: Column) -> Column:
        n = F.greatest(F.size(ring) - 1, F.lit(0))
        return F.forall(F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda p, q: p != q), lambda differs: differs)

    flagged = polygons.select(
        code,
        every(lambda r: (F.size(r) == 0) | (F.try_element_at(r, F.lit(1)) == F.try_element_at(r, F.lit(-1)))).alias("closed"),
        every(lambda r: F.size(r) >= 4).alias("enough_points"),
        every(no_repeat).alias("no_repeats"),
    )
    contacts = stage(ring_contacts(polygons, code, limit).distinct(), "ring-contacts")
    crossing = contacts.filter("crossed").select(code).distinct().withColumn("_crossed", F.lit(True))
    joined = flagged.join(crossing.hint("merge"), code, "left").withColumn("uncrossed", F.col("_crossed").isNull())
    sound = joined.filter("closed AND enough_points AND uncrossed").select(code)
    several = stage(_numbered(polygons, code).join(sound.hint("merge"), code, "left_semi"), "several-rings")
    segments = stage(ring_segments(several, [code]), "ring-segments")
    touches = contacts.join(several.select(code).hint("merge"), code, "left_semi").filter("ring_a <> ring_b")
    nodes = stage(_nodes(touches, segments, code), "ring-nodes")
    misplaced = _misplaced(several, segments, nodes, code)
    cut = _cut_interiors(several, touches, code).withColumn("_cut", F.lit(True))
    joined = joined.join(misplaced.hint("merge"), code, "left").join(cut.hint("merge"), code, "left")
    joined = joined.withColumns(
        {
            "holes_inside": ~F.coalesce("stray", F.lit(False)),
            "rings_apart": ~F.coalesce("nested", F.lit(False)),
            "interior_whole": F.col("_cut").isNull(),
        }
    )
    flags = ["closed", "enough_points", "no_repeats", "uncrossed", "holes_inside", "rings_apart", "interior_whole"]
    valid = F.lit(True)
    for flag in flags:
        valid = valid if flag == "no_repeats" else valid & F.col(flag)
    return joined.select(code, *flags, valid.alias("valid"))
