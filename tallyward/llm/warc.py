"""WARC archives as a PySpark data source (``warc``).

Writing: each task writes archives of at most ``roll`` bytes, a gzip member for each record. The member's header has
an ``sl`` extra field with its compressed and plain length, as Annex D of the WARC standard allows. The commit writes a
manifest, one for each write; a reader takes the archives that the manifests list, so files of lost or repeated task attempts are
never read, an append adds, and an overwrite takes the place of all earlier writes.

Reading: a partition is one archive. Type and header predicates are pushed to the reader. For each record it inflates the
headers only, tests the predicates, and skips an unwanted record by its length without reading or inflating the rest.
Payloads can be left out altogether (``payload=false``). Archives of other writers are read too: plain ones, members
without ``sl`` (inflated in pieces to find their end), and folders without a manifest.

Paths are those that ``pyarrow.fs`` knows (``file``, ``hdfs``, ``s3``, ``gs``) and must be visible to all executors.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

SCHEMA = (
    "warc_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, "
    "payload_bytes long, headers map<string,string>, payload binary, archive string, position long"
)
# Columns that are header fields, with the field's name.
FIELDS = {
    "warc_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
LENGTH_FIELD = "X-Payload-Length"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest"
ROLL = 256 << 20
LEVEL = 4
BATCH_BYTES = 16 << 20
BATCH_ROWS = 4096
_PIECE = 1 << 16


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line; control characters are percent-encoded."""
    return "".join(quote(c) if c < " " or c == "\x7f" else c for c in value)


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A WARC/1.1 record; fields without a value are left out."""
    lines = [f"{k}: {_line(v)}" for k, v in headers if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with the ``sl`` field: lengths of the whole member and of its content (0 where over 32 bits)."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    lengths = (size, len(data)) if max(size, len(data)) < 1 << 32 else (0, 0)
    extra = b"sl" + struct.pack("<HII", 8, *lengths)
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def page_record(row: dict) -> bytes:
    """Record of one row (``warc_type``, ``record_id``, ``target_uri``, ``warc_date``, ``payload_sha1``
    in hex, ``payload_bytes``, ``refers_to``, ``payload``): a response holds the payload, a revisit only its headers."""
    revisit = row["warc_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    headers = [(name, row.get(column)) for column, name in FIELDS.items()]
    digest = base64.b32encode(bytes.fromhex(row["payload_sha1"])).decode()
    headers[4] = (FIELDS["payload_digest"], f"sha1:{digest}")
    headers += [(LENGTH_FIELD, str(row["payload_bytes"])), ("WARC-Profile", PROFILE if revisit else None)]
    return record([*headers, ("Content-Type", "application/http; msgtype=response")], http if revisit else http + row["payload"])


@dataclass
class Written(WriterCommitMessage):
    archives: list[str]


def manifests(system: fs.FileSystem, folder: str) -> list[str]:
    """The files of a folder that name the archives of one commit each."""
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.path.rsplit("/", 1)[-1].startswith(f"{MANIFEST}-"))


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, roll: int, overwrite: bool) -> None:
        self.path, self.roll, self.overwrite = path, roll, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        out, size, archives = None, 0, []
        try:
            for batch in iterator:
                columns = [c.to_pylist() for c in batch.columns]
                for values in zip(*columns):
                    data = member(page_record(dict(zip(batch.schema.names, values))))
                    if out is None or size + len(data) > self.roll:
                        if out is not None:
                            out.close()
                        archives.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = system.open_output_stream(f"{folder}/{archives[-1]}", compression=None), 0
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(archives)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        names = sorted(a for m in messages if m for a in m.archives)
        earlier = [p.rsplit("/", 1)[-1] for p in manifests(system, folder)] if self.overwrite else []
        with system.open_output_stream(f"{folder}/{MANIFEST}-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps({"archives": names, "replaces": earlier}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = file_system(self.path)
        for message in messages:
            for archive in message.archives if message else ():
                system.delete_file(f"{folder}/{archive}")


class _Member:
    """One gzip member at ``start`` of an open archive, inflated only as far as it is asked for."""

    def __init__(self, source: pa.NativeFile, start: int) -> None:
        self.source, self.start = source, start
        source.seek(start)
        head = source.read(12)
        self.end, extra = None, 0
        if head[3] & 4:
            extra = struct.unpack("<H", head[10:12])[0]
            fields = source.read(extra)
            while len(fields) >= 4:
                kind, size = fields[:2], struct.unpack("<H", fields[2:4])[0]
                if kind == b"sl" and size == 8 and (whole := struct.unpack("<I", fields[4:8])[0]):
                    self.end = start + whole
                fields = fields[4 + size :]
        source.seek(start)
        self.inflate, self.plain, self.pending = zlib.decompressobj(31), bytearray(), b""

    def more(self, keep: bool = True) -> bool:
        """Inflate one more piece; false at the end of the member."""
        if self.inflate.eof:
            return False
        if not self.pending:
            limit = _PIECE if self.end is None else min(_PIECE, self.end - self.source.tell())
            self.pending = self.source.read(limit)
            if not self.pending:
                raise ValueError(f"archive ends inside the record at {self.start}")
        got = self.inflate.decompress(self.pending, _PIECE)
        self.pending = self.inflate.unconsumed_tail
        if keep:
            self.plain += got
        return True

    def skip(self) -> int:
        """Where the next member starts."""
        if self.end is None:
            while self.more(keep=False):
                pass
            self.end = self.source.tell() - len(self.inflate.unused_data)
        return self.end


class _Plain:
    """One record of an archive that is not compressed."""

    def __init__(self, source: pa.NativeFile, start: int) -> None:
        self.source, self.start, self.plain, self.length = source, start, bytearray(), None
        source.seek(start)

    def more(self) -> bool:
        got = self.source.read(_PIECE)
        self.plain += got
        return bool(got)

    def skip(self) -> int:
        return self.start + self.length


def _headers(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def records(source: pa.NativeFile, wanted, payload: bool) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """Position, headers and payload (None if not asked for) of the records that ``wanted(headers)`` takes."""
    size, at = source.size(), 0
    source.seek(0)
    packed = source.read(2) == b"\x1f\x8b"
    while at < size:
        item = (_Member if packed else _Plain)(source, at)
        while (cut := item.plain.find(b"\r\n\r\n")) < 0 and item.more():
            pass
        headers = _headers(bytes(item.plain[: max(cut, 0)]))
        start, length = cut + 4, int(headers.get("Content-Length", 0))
        item.length = start + length + 4
        if wanted(headers):
            body = None
            if payload and headers.get("WARC-Type") != "revisit":
                while len(item.plain) < start + length and item.more():
                    pass
                block = bytes(item.plain[start : start + length])
                http = headers.get("Content-Type", "").startswith("application/http")
                body = block.partition(b"\r\n\r\n")[2] if http else block
            yield at, headers, body
        at = item.skip()


@dataclass
class Archive(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool) -> None:
        self.path, self.payload, self.verify, self.tests = path, payload, verify, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality, membership and presence of header fields; give the rest back to Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if column not in FIELDS:
                yield f
            elif not isinstance(f, IsNotNull):
                self.tests.append((column, {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                self.tests.append((column, None))

    def partitions(self) -> list[Archive]:
        system, folder = file_system(self.path)
        if system.get_file_info(folder).type == fs.FileType.File:
            return [Archive(folder)]
        commits = {}
        for path in manifests(system, folder):
            with system.open_input_stream(path) as source:
                commits[path.rsplit("/", 1)[-1]] = json.loads(source.read())
        if commits:
            gone = {name for c in commits.values() for name in c["replaces"]}
            return [Archive(f"{folder}/{a}") for name in sorted(commits) if name not in gone for a in commits[name]["archives"]]
        found = system.get_file_info(fs.FileSelector(folder, recursive=True))
        return [Archive(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith((".warc", ".warc.gz"))]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Archive):  # no archive at all
            return
        system, _ = file_system(self.path)
        rows, size = [], 0
        with system.open_input_file(partition.path) as source:
            for at, headers, payload in records(source, self._wanted, self.payload):
                values = {c: _value(c, headers) for c in FIELDS}
                if self.verify and payload is not None and sha1_base32(payload) != values["payload_digest"]:
                    raise ValueError(f"digest of the record at {at} in {partition.path} does not fit its payload")
                length = len(payload) if payload is not None else headers.get(LENGTH_FIELD)
                values |= {"payload_bytes": None if length is None else int(length), "headers": list(headers.items())}
                rows.append(values | {"payload": payload, "archive": partition.path, "position": at})
                size += len(payload or b"")
                if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def _wanted(self, headers: dict[str, str]) -> bool:
        return all((v := _value(c, headers)) is not None and (among is None or v in among) for c, among in self.tests)


_ARROW = pa.schema(
    [*((c, pa.string()) for c in FIELDS), ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string()))]
    + [("payload", pa.binary()), ("archive", pa.string()), ("position", pa.int64())]
)


def _value(column: str, headers: dict[str, str]) -> str | None:
    value = headers.get(FIELDS[column])
    return value.removeprefix("sha1:") if column == "payload_digest" and value else value


class WarcSource(DataSource):
    """Options: ``path``; reading ``payload`` (default true), ``verify`` (default false: compare digests); writing ``roll``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def _flag(self, name: str, default: str) -> bool:
        return self.options.get(name, default).lower() == "true"

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self._flag("payload", "true"), self._flag("verify", "false"))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("roll", ROLL)), overwrite)


def register(spark: SparkSession) -> None:
    """Make ``warc`` known to the session and let Spark push filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
