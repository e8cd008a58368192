"""Polygon layers as shapefiles: a data source with record ranges as partitions and filters that spare reading shapes.

    register(spark)
    spark.read.format("polygons").load(path)          # a .shp file, or a folder of them
    layer.write.format("polygons").mode("append").save(folder)

Columns are the attributes of the ``.dbf``, ``rings`` and ``part_sizes`` as in ``files.read_boundary_lines``, and the box (``minx``,
``miny``, ``maxx``, ``maxy``) that each record carries in front of its points. The ``.shx`` has an entry of fixed size for each
record, and so has the ``.dbf``; so the driver reads file sizes and one header only, and a task its own slices. Filters on
attributes are tried on the ``.dbf`` slice, filters on the box on the 44 bytes at the head of a record; the points of records
that fail are never read.

Files have shells clockwise and holes the other way; rows have it the other way round, as GeoJSON. Holes may stand anywhere
in a record, and come after the shell that contains them. A row without rings is a null shape. Blank attributes are null;
the format cannot tell empty text from it. Text is UTF-8 of at most 254 bytes, names have at most 10.

A write makes one set of files for each ``ROLL_BYTES`` of shapes and attributes of a task, held as bytes until then, and names them in a commit file of its own, written last. Folders
with commit files are read through these alone, so what a lost attempt leaves behind is never seen; ``overwrite`` takes
the place of all earlier commits. Paths go through ``pyarrow.fs``, so the folder must be one that all executors reach.
"""

from __future__ import annotations

import datetime
import json
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession, types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan,
    LessThanOrEqual, WriterCommitMessage,
)

PART_BYTES = 8 << 20
PART_RECORDS = 50_000
ROLL_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
BATCH_RECORDS = 8_000
WRITE_ROWS = 2_000
COMMITS = "_commits"
BOX = ("minx", "miny", "maxx", "maxy")
# Fixed values of the published format.
FILE_CODE, VERSION, NULL_SHAPE, POLYGON = 9994, 1000, 0, 5
HEADER, INDEX_ENTRY, RECORD_HEAD, SHAPE_HEAD = 100, 8, 8, 44
DBF_HEADER, DBF_FIELD, DBF_END, TEXT_BYTES, NAME_BYTES = 32, 32, 0x0D, 254, 10

RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
GEOMETRY = [T.StructField("rings", RINGS), T.StructField("part_sizes", T.ArrayType(T.IntegerType()))] + [T.StructField(c, T.DoubleType()) for c in BOX]
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Field:
    """A column of a ``.dbf``: its kind (C, N, F, L or D), width in bytes, decimals, and offset in a record."""

    name: str
    kind: str
    width: int
    decimals: int
    at: int

    def type(self) -> T.DataType:
        if self.kind == "N" and self.decimals == 0:
            return T.LongType()
        return {"N": T.DoubleType(), "F": T.DoubleType(), "L": T.BooleanType(), "D": T.DateType()}.get(self.kind, T.StringType())

    def value(self, record: bytes):
        text = record[self.at : self.at + self.width].decode("utf-8", "replace").rstrip(" \0")
        if self.kind not in "NFLD":
            return text or None
        text = text.strip()
        if not text or text.strip("*?") == "":
            return None
        if self.kind == "D":
            return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8]))
        if self.kind == "L":
            return text in "YyTt"
        return int(text) if self.kind == "N" and self.decimals == 0 else float(text)

    def text(self, value) -> bytes:
        if value is None:
            return b" " * self.width
        if self.kind == "D":
            value = value.strftime("%Y%m%d")
        elif self.kind == "L":
            value = "T" if value else "F"
        out = (repr(value) if self.kind in "NF" else value).encode()
        if len(out) > self.width:
            raise ValueError(f"{self.name}: {len(out)} bytes do not fit the {self.width} of the format")
        return out.rjust(self.width) if self.kind in "NF" else out.ljust(self.width)


def fields_of(schema: T.StructType) -> list[Field]:
    """The ``.dbf`` columns for the attributes of a schema."""
    shapes = {f.name for f in GEOMETRY}
    kinds = {
        T.StringType: ("C", TEXT_BYTES), T.LongType: ("N", 20), T.IntegerType: ("N", 11), T.ShortType: ("N", 6), T.DoubleType: ("F", 25),
        T.BooleanType: ("L", 1), T.DateType: ("D", 8),
    }
    out, at = [], 1
    for f in schema.fields:
        if f.name in shapes:
            continue
        if type(f.dataType) not in kinds or len(f.name.encode()) > NAME_BYTES:
            raise ValueError(f"column {f.name} ({f.dataType.simpleString()}) has no place in the format")
        kind, width = kinds[type(f.dataType)]
        out.append(Field(f.name, kind, width, 0, at))
        at += width
    return out


def read_fields(source: pa.NativeFile) -> tuple[list[Field], int, int]:
    """Fields, bytes of the header and bytes of a record."""
    head = source.read(DBF_HEADER)
    size, width = struct.unpack("<HH", head[8:12])
    body, fields, at = source.read(size - DBF_HEADER), [], 1
    for k in range(0, len(body), DBF_FIELD):
        if body[k] == DBF_END:
            break
        name, kind, length, decimals = body[k : k + 11], chr(body[k + 11]), body[k + 16], body[k + 17]
        fields.append(Field(name.split(b"\0")[0].decode("utf-8", "replace"), kind, length, decimals, at))
        at += length
    return fields, size, width


def signed_area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2


def _inside(point: np.ndarray, ring: np.ndarray) -> bool:
    (x, y), (x1, y1), (x2, y2) = point, ring[:-1].T, ring[1:].T
    up = (y1 <= y) != (y2 <= y)
    with np.errstate(divide="ignore", invalid="ignore"):
        return bool(np.count_nonzero(up & (x < x1 + (y - y1) / (y2 - y1) * (x2 - x1))) % 2)


def grouped(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Parts of a record's rings: every clockwise ring is a shell; another goes to the smallest shell around its first point,
    or to the one before it if there is none."""
    shells = [k for k, r in enumerate(rings) if len(r) and signed_area(r) <= 0] or [0]
    parts = {k: [rings[k]] for k in shells}
    sizes = {k: abs(signed_area(rings[k])) if len(rings[k]) else 0.0 for k in shells}
    for k, ring in enumerate(rings):
        if k not in parts:
            around = [s for s in shells if len(shells) > 1 and len(ring) and _inside(ring[0], rings[s])]
            before = max((s for s in shells if s < k), default=shells[0])
            parts[min(around, key=sizes.get) if around else before].append(ring)
    return list(parts.values())


def encode(rings: list | None, part_sizes: list | None) -> tuple[bytes, np.ndarray | None]:
    """Content of a polygon record, and its box."""
    if not rings:
        return struct.pack("<i", NULL_SHAPE), None
    sizes, turned, at = part_sizes or [len(rings)], [], 0
    for size in sizes:
        for k, ring in enumerate(rings[at : at + size]):
            points = np.array([(p["x"], p["y"]) for p in ring], "<f8").reshape(-1, 2)
            wrong = signed_area(points) > 0 if k == 0 else signed_area(points) < 0
            turned.append(points[::-1] if wrong else points)
        at += size
    points = np.concatenate(turned)
    box = np.concatenate([points.min(axis=0), points.max(axis=0)]).astype("<f8")
    starts = np.cumsum([0, *map(len, turned[:-1])]).astype("<i4")
    return struct.pack("<i", POLYGON) + box.tobytes() + struct.pack("<ii", len(turned), len(points)) + starts.tobytes() + points.tobytes(), box


def decode(content: bytes) -> list[list[np.ndarray]]:
    """Parts of a polygon record, shells first, in the sense of GeoJSON."""
    if struct.unpack_from("<i", content)[0] != POLYGON:
        return []
    n_rings, n_points = struct.unpack_from("<ii", content, 36)
    starts = np.frombuffer(content, "<i4", n_rings, SHAPE_HEAD)
    points = np.frombuffer(content, "<f8", 2 * n_points, SHAPE_HEAD + 4 * n_rings).reshape(-1, 2)
    return [[r[::-1] for r in part] for part in grouped(np.split(points, starts[1:]))] if n_rings else []


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Held:
    """Records of the next set of files: ``.shp`` and ``.dbf`` records as bytes, 16-bit words of each shape, and the box of all."""

    def __init__(self) -> None:
        self.shapes, self.rows, self.words, self.box = bytearray(), bytearray(), array("q"), None

    def add(self, content: bytes, box: np.ndarray | None, row: bytes) -> None:
        self.words.append(len(content) // 2)
        self.shapes += struct.pack(">ii", len(self.words), len(content) // 2) + content
        self.rows += row
        if box is not None:
            self.box = box if self.box is None else np.concatenate([np.minimum(self.box[:2], box[:2]), np.maximum(self.box[2:], box[2:])])


class PolygonWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool) -> None:
        self.path, self.fields, self.overwrite = path, fields_of(schema), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names, held = [], Held()
        for batch in iterator:
            for at in range(0, batch.num_rows, WRITE_ROWS):
                for row in batch.slice(at, WRITE_ROWS).to_pylist():
                    held.add(*encode(row.get("rings"), row.get("part_sizes")), b" " + b"".join(f.text(row[f.name]) for f in self.fields))
                    if len(held.shapes) + len(held.rows) > ROLL_BYTES:
                        names.append(self._set(held))
                        held = Held()
        if held.words:
            names.append(self._set(held))
        return Written(names)

    def _set(self, held: Held) -> str:
        """One set of files; its name."""
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}"
        box = (np.zeros(4) if held.box is None else held.box).astype("<f8").tobytes() + bytes(32)
        words = np.array(held.words, np.int64)
        ends = HEADER // 2 + np.cumsum(words + RECORD_HEAD // 2)
        index = np.stack([ends - words - RECORD_HEAD // 2, words], axis=1).astype(">i4")

        def head(size: int) -> bytes:
            return struct.pack(">i20xi", FILE_CODE, size) + struct.pack("<ii", VERSION, POLYGON) + box

        width = 1 + sum(f.width for f in self.fields)
        columns = b"".join(
            f.name.encode().ljust(11, b"\0") + f.kind.encode() + bytes(4) + bytes([f.width, f.decimals]) + bytes(14) for f in self.fields
        )
        header = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(words), DBF_HEADER + len(columns) + 1, width)
        for suffix, parts in (
            ("shp", (head(int(ends[-1])), held.shapes)),
            ("shx", (head((HEADER + INDEX_ENTRY * len(words)) // 2), index.tobytes())),
            ("dbf", (header, columns, bytes([DBF_END]), held.rows, b"\x1a")),
            ("cpg", (b"UTF-8",)),
        ):
            with system.open_output_stream(f"{folder}/{name}.{suffix}") as out:
                for part in parts:
                    out.write(part)
        return name

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = file_system(self.path)
        system.create_dir(f"{folder}/{COMMITS}", recursive=True)
        earlier = [f.path for f in system.get_file_info(fs.FileSelector(f"{folder}/{COMMITS}"))] if self.overwrite else []
        names = sorted(n for m in messages if m for n in m.names)
        with system.open_output_stream(f"{folder}/{COMMITS}/{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps({"sets": names, "replaces": [p.rsplit("/", 1)[-1] for p in earlier]}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Sets without a commit are never read."""


@dataclass
class Records(InputPartition):
    """Records ``first`` to ``last`` (exclusive) of a set of files."""

    stem: str
    first: int
    last: int


def stems(path: str) -> list[str]:
    """The sets of files at ``path``, without suffix."""
    system, folder = file_system(path)
    if folder.endswith(".shp"):
        return [folder[:-4]]
    found = system.get_file_info(fs.FileSelector(f"{folder}/{COMMITS}", allow_not_found=True))
    commits = {}
    for info in found:
        with system.open_input_stream(info.path) as source:
            commits[info.path.rsplit("/", 1)[-1]] = json.loads(source.read())
    if commits:
        gone = {r for c in commits.values() for r in c["replaces"]}
        return [f"{folder}/{n}" for k in sorted(commits) if k not in gone for n in commits[k]["sets"]]
    return sorted(f.path[:-4] for f in system.get_file_info(fs.FileSelector(folder, recursive=True)) if f.path.endswith(".shp"))


class PolygonReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.schema, self.attribute_tests, self.box_tests = path, schema, [], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality and membership of attributes and comparisons of the box; give the rest back to Spark."""
        shapes = {f.name for f in GEOMETRY}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, (EqualTo, In)) and name in self.schema.fieldNames() and name not in shapes:
                self.attribute_tests.append((name, {f.value} if isinstance(f, EqualTo) else set(f.value)))
            elif isinstance(f, (LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)) and name in BOX:
                self.box_tests.append((BOX.index(name), type(f).__name__, f.value))
            else:
                yield f

    def partitions(self) -> list[Records]:
        system, _ = file_system(self.path)
        out = []
        for stem in stems(self.path):
            index, shapes = system.get_file_info([f"{stem}.shx", f"{stem}.shp"])
            n = (index.size - HEADER) // INDEX_ENTRY
            tasks = max(1, -(-shapes.size // PART_BYTES), -(-n // PART_RECORDS))
            cuts = [n * k // tasks for k in range(tasks + 1)]
            out += [Records(stem, a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
        return out

    def read(self, partition: Records | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Records):  # no files at all
            return
        system, _ = file_system(self.path)
        count = partition.last - partition.first
        with system.open_input_file(f"{partition.stem}.shx") as source:
            source.seek(HEADER + INDEX_ENTRY * partition.first)
            index = np.frombuffer(source.read(INDEX_ENTRY * count), ">i4").reshape(-1, 2).astype(np.int64) * 2
        with system.open_input_file(f"{partition.stem}.dbf") as source:
            fields, size, width = read_fields(source)
            source.seek(size + width * partition.first)
            rows = source.read(width * count)
        tests = [(next((f for f in fields if f.name == n), None), among) for n, among in self.attribute_tests]
        held, size = [], 0
        with system.open_input_file(f"{partition.stem}.shp") as source:
            for k, (at, length) in enumerate(index.tolist()):
                row = rows[width * k : width * (k + 1)]
                if row[:1] == b"*" or not all(f is not None and f.value(row) in among for f, among in tests):
                    continue
                source.seek(at + RECORD_HEAD)
                head = source.read(min(SHAPE_HEAD, length))
                box = struct.unpack_from("<4d", head, 4) if len(head) >= 36 else (None,) * 4
                if not all(_holds(box[i], how, value) for i, how, value in self.box_tests):
                    continue
                parts = self.shape(head + source.read(length - len(head)))
                held.append(({f.name: f.value(row) for f in fields}, parts, box))
                size += length
                if size > BATCH_BYTES or len(held) >= BATCH_RECORDS:
                    yield self._batch(held)
                    held, size = [], 0
        if held:
            yield self._batch(held)

    def shape(self, content: bytes) -> list[list[np.ndarray]]:
        return decode(content)

    def _batch(self, held: list[tuple]) -> pa.RecordBatch:
        rings = [[r for part in parts for r in part] for _, parts, _ in held]
        flat = [r for each in rings for r in each]
        points = np.concatenate(flat) if flat else np.empty((0, 2))
        ends = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
        xy = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(points[:, i])) for i in (0, 1)], fields=list(_POINT))
        nested = pa.ListArray.from_arrays(ends(map(len, rings)), pa.ListArray.from_arrays(ends(map(len, flat)), xy))
        sizes = pa.array([[len(p) for p in parts] for _, parts, _ in held], pa.list_(pa.int32()))
        geometry = {"rings": nested, "part_sizes": sizes} | {c: pa.array([b[i] for *_, b in held], pa.float64()) for i, c in enumerate(BOX)}
        arrow = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(), T.DateType: pa.date32()}
        columns = [
            geometry[f.name] if f.name in geometry else pa.array([a.get(f.name) for a, *_ in held], arrow.get(type(f.dataType), pa.string()))
            for f in self.schema.fields
        ]
        return pa.RecordBatch.from_arrays(columns, self.schema.fieldNames())


def _holds(x: float | None, how: str, value: float) -> bool:
    if x is None:
        return False
    return {"LessThan": x < value, "LessThanOrEqual": x <= value, "GreaterThan": x > value, "GreaterThanOrEqual": x >= value}[how]


class PolygonSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "polygons"

    def schema(self) -> T.StructType:
        """Attributes of the first set of files; all sets of a layer have the same."""
        system, _ = file_system(self.options["path"])
        found = stems(self.options["path"])
        if not found:
            raise ValueError(f"no shapefile at {self.options['path']}")
        with system.open_input_file(f"{found[0]}.dbf") as source:
            return T.StructType([T.StructField(f.name, f.type()) for f in read_fields(source)[0]] + GEOMETRY)

    def reader(self, schema: T.StructType) -> PolygonReader:
        return PolygonReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> PolygonWriter:
        return PolygonWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PolygonSource)
