"""Map extracts: nodes, ways and relations from object-per-line files, and tagged points with the vertices of shapes.

A line is one object (``n17 v2 dV Tamenity=pub,name=The%20%Crown x-1.5 y52.25``), so a file is cut into blocks anywhere and
parsed by column expressions in the tasks. Ways list their nodes (``Nn1,n2``), relations their members (``Mn1@role,w2@``).

``elements`` have ``kind`` (n, w or r), ``id``, ``version``, ``visible``, ``tags`` (key, value), ``lon``, ``lat`` and ``refs``
(kind, id, role).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyward.sources.staging import stage

# Characters that the format writes as their code point in hexadecimal between percent signs.
ESCAPED = (("%", "25"), (" ", "20"), (",", "2c"), ("=", "3d"), ("@", "40"), ("\n", "a"), ("\r", "d"), ("\t", "9"))
_CODE_POINT = r"^(?!0?[dD][89a-fA-F]..$)(10[0-9a-fA-F]{4}|[0-9a-fA-F]{1,5})$"


def decoded(text: Column) -> Column:
    """Text with its escapes resolved; what is no code point between percent signs is left out."""
    code = lambda p: F.when(p.rlike(_CODE_POINT), F.decode(F.unhex(F.lpad(p, 8, "0")), "UTF-32"))
    pieces = F.transform(F.split(text, "%"), lambda p, i: F.when(i % 2 == 1, code(p)).otherwise(p))
    return F.when(F.contains(text, F.lit("%")), F.array_join(pieces, "")).otherwise(text)


def encoded(text: Column) -> Column:
    for character, code in ESCAPED:
        text = F.replace(text, F.lit(character), F.lit(f"%{code}%"))
    return text


def _field(letter: str) -> Column:
    """The field of a line that starts with ``letter``; empty if it has none."""
    return F.regexp_extract("value", f" {letter}([^ ]*)", 1)


def _listed(field: Column) -> Column:
    return F.filter(F.split(field, ","), lambda part: part != "")


def read_extract(spark: SparkSession, path: str) -> DataFrame:
    """``elements`` of the files at ``path``. Lines that are no node, way or relation are left out.

    A missing version is 0; an object is visible unless its line says that it was deleted; tags without a value have an
    empty one; coordinates that are no numbers are NULL.
    """
    lines = spark.read.text(path).filter(F.col("value").rlike(r"^[nwr]-?\d{1,18}( |$)"))
    part = lambda t, n: decoded(F.coalesce(F.get(F.split(t, "="), F.lit(n)), F.lit("")))
    tags = F.transform(_listed(_field("T")), lambda t: F.struct(part(t, 0).alias("key"), part(t, 1).alias("value")))
    reference = lambda kind, text, role: F.struct(kind.alias("kind"), F.regexp_extract(text, r"^[nwr](-?\d+)", 1).try_cast("long").alias("id"), role.alias("role"))
    nodes = F.transform(_listed(_field("N")), lambda t: reference(F.lit("n"), t, F.lit("")))
    role = lambda t: decoded(F.coalesce(F.get(F.split(t, "@"), F.lit(1)), F.lit("")))
    members = F.transform(_listed(_field("M")), lambda t: reference(F.substring(t, 1, 1), t, role(t)))
    kind = F.substring("value", 1, 1)
    return lines.select(
        kind.alias("kind"),
        F.regexp_extract("value", r"^[nwr](-?\d+)", 1).cast("long").alias("id"),
        F.coalesce(_field("v").try_cast("int"), F.lit(0)).alias("version"),
        (_field("d") != "D").alias("visible"),
        tags.alias("tags"),
        F.when(kind == "n", _field("x").try_cast("double")).alias("lon"),
        F.when(kind == "n", _field("y").try_cast("double")).alias("lat"),
        F.when(kind == "w", nodes).when(kind == "r", members).otherwise(F.array().cast("array<struct<kind:string,id:bigint,role:string>>")).alias("refs"),
    )


def write_extract(elements: DataFrame, path: str) -> None:
    """One line for each object; coordinates with seven decimals."""
    tags = F.transform("tags", lambda t: F.concat(encoded(t["key"]), F.lit("="), encoded(t["value"])))
    number = lambda r: r["id"].cast("string")
    nodes = F.transform("refs", lambda r: F.concat(F.lit("n"), number(r)))
    members = F.transform("refs", lambda r: F.concat(r["kind"], number(r), F.lit("@"), encoded(r["role"])))
    body = (
        F.when(F.col("kind") == "w", F.concat(F.lit("N"), F.array_join(nodes, ",")))
        .when(F.col("kind") == "r", F.concat(F.lit("M"), F.array_join(members, ",")))
        .otherwise(F.format_string("x%.7f y%.7f", "lon", "lat"))
    )
    body = F.when((F.col("kind") == "n") & (F.col("lon").isNull() | F.col("lat").isNull()), F.lit("x y")).otherwise(body)
    head = F.concat(F.col("kind"), F.col("id").cast("string"))
    state = F.concat(F.lit("d"), F.when(F.col("visible"), F.lit("V")).otherwise(F.lit("D")))
    version = F.concat(F.lit("v"), F.col("version").cast("string"))
    line = F.concat_ws(" ", head, version, state, F.concat(F.lit("T"), F.array_join(tags, ",")), body)
    elements.select(line.alias("value")).write.mode("errorifexists").text(path)


def latest(elements: DataFrame) -> DataFrame:
    """The newest version of each object of histories or overlapping extracts; objects whose newest is a deletion go."""
    rest = [c for c in elements.columns if c not in ("kind", "id", "version")]
    newest = elements.groupBy("kind", "id").agg(F.max(F.struct("version", *rest)).alias("_newest"))
    return newest.select("kind", "id", "_newest.*").filter("visible").select(elements.columns)


def tagged_points(elements: DataFrame, tags: Iterable[tuple[str, str]], vertices: bool = True) -> DataFrame:
    """Points of interest by tag: ``poi_id``, ``key``, ``value``, ``name``, ``lon``, ``lat`` and ``own``.

    With ``vertices``, the points of a tag are its nodes and all nodes of its ways and relations: those of a way, the
    members of a relation, and the nodes of a relation's ways; relations in relations are not followed. A node has a row for
    each of the tags, however many shapes hand it down; ``own`` says that it has the tag itself. ``name`` is the node's own,
    so a name rule leaves most vertices out. Members that the extract lacks, and nodes without a place, have no rows.

    Shapes are reduced to distinct (member, tag) before they meet the elements, so a node or way that many shapes share
    meets a row for each tag and not for each shape. ``elements`` has one row an object; see ``latest``.
    """
    wanted = sorted({f"{k}={v}" for k, v in tags})
    seen = elements.filter("visible")
    is_wanted = lambda t: F.concat(t["key"], F.lit("="), t["value"]).isin(wanted)
    hits = seen.filter(F.exists("tags", is_wanted)).withColumn("hit", F.explode(F.array_distinct(F.filter("tags", is_wanted))))
    name = F.get(F.filter("tags", lambda t: t["key"] == "name"), F.lit(0))["value"].alias("name")
    nodes = seen.filter("kind = 'n' AND lon IS NOT NULL AND lat IS NOT NULL")
    own = hits.filter("kind = 'n' AND lon IS NOT NULL AND lat IS NOT NULL")
    own = own.select("id", "hit.key", "hit.value", name, "lon", "lat", F.lit(True).alias("own"))
    points = own
    if vertices:
        handed = hits.filter("kind <> 'n'").select("hit.key", "hit.value", F.explode("refs").alias("ref"))
        members = stage(handed.select("key", "value", "ref.kind", "ref.id").filter("kind IN ('n', 'w') AND id IS NOT NULL").distinct(), "members")
        ways = members.filter("kind = 'w'").drop("kind").join(seen.filter("kind = 'w'").select("id", "refs"), "id")
        through = ways.select("key", "value", F.explode("refs.id").alias("id"))
        corners = members.filter("kind = 'n'").select("key", "value", "id").union(through).distinct()
        placed = nodes.select("id", name, "lon", "lat").join(corners, "id")
        points = own.unionByName(placed.withColumn("own", F.lit(False)))
    one = points.groupBy("id", "key", "value").agg(F.max(F.struct("own", "name", "lon", "lat")).alias("p"))
    return one.select(F.col("id").alias("poi_id"), "key", "value", "p.name", "p.lon", "p.lat", "p.own")
