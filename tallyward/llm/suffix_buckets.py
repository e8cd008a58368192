"""Removal of repeated byte strings by bucket refinement over suffixes.

Every byte goes that is covered by a string of ``length`` bytes that also starts anywhere else. Sorting all suffixes of
a corpus to that depth would move each byte many times; here the suffixes stay together in runs and only runs whose
bucket is still undecided are refined.

Buckets. In the string that starts at byte i, the least ``GRAM``-byte gram (by hash, leftmost of equals) is its anchor.
Equal strings have equal anchors at equal offsets, and neighbouring starts mostly share their anchor, so the suffixes of
a document fall into runs: an anchor and a range of offsets before it. The first bucket of a run is its anchor's gram.

Refinement. A run is settled at once if its whole extent (all bytes of all its strings) occurs in another run of the
bucket: all its starts repeat. It is settled too if nothing else shares its bucket: none does. The others are cut into
shorter ranges of offsets (64, 16, 4, then single starts); the new bucket of a piece is made of its old bucket's
identifier and the bytes that all strings of the range share at the later offsets. Identifiers are reused from round to
round. Of pieces that are settled while others of their bucket are not, one stays as a witness, so that those others can
still be found to repeat. After the last round a bucket is one string, and every start is settled.

A round has one row for each undecided run, near the ends of repeats, not for each suffix; nothing is done by pairs. Rows
of a bucket are only counted and reduced, never gathered, so a passage that very many documents share is no large group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyward.llm.rolling import _TABLE, windows
from tallyward.sources.staging import fresh_path, remove, stage, stage_at

LENGTH = 200
GRAM = 32
STEPS = (64, 16, 4, 1)
_SLAB = 1 << 21
_LOW = np.uint64((1 << 22) - 1)

_RUN = "gram long, whole long, doc long, mark int, at int, up int, down int"


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` consecutive keys."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, anchor, first and last start of each run of a text; long texts go in slabs."""
    found: list[np.ndarray] = []
    starts = len(data) - length + 1
    for at in range(0, starts, _SLAB):
        m = min(_SLAB, starts - at)
        grams = windows(_TABLE[np.frombuffer(data, np.uint8, m + length - 1, at)], gram)
        place = np.arange(len(grams), dtype=np.uint64)
        anchor = (_least(grams & ~_LOW | place, length - gram + 1) & _LOW).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        last = np.append(first[1:], m) - 1
        a = anchor[first]
        rows = np.stack([grams[a].view(np.int64), a + at, first + at, last + at])
        if found and found[-1][1, -1] == rows[1, 0]:  # a run that goes on from the slab before
            found[-1][3, -1] = rows[3, 0]
            rows = rows[:, 1:]
        found.append(rows)
    return tuple(np.concatenate(found, axis=1)) if found else (np.empty(0, np.int64),) * 4


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(7)]
            for doc, mark, text in zip(*(c.to_pylist() for c in batch.columns)):
                grams, at, first, last = runs_of(text, length, gram)
                digest, ends = xxhash.xxh64_intdigest, (last + length).tolist()
                whole = np.fromiter((digest(text[a:b]) for a, b in zip(first.tolist(), ends)), np.uint64, len(at))
                n = len(at)
                for column, values in zip(columns, (grams, whole.view(np.int64), np.full(n, doc), np.full(n, mark), at, at - first, at - last)):
                    column.append(values)
            kinds = [np.int64] * 3 + [np.int32] * 4
            arrays = [pa.array(np.concatenate([np.empty(0, k), *c]).astype(k)) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["gram", "whole", "doc", "mark", "at", "up", "down"])

    return run


def _extents(length: int):
    """Cut the extents of a text's runs out of it."""
    names = ["bucket", "doc", "mark", "at", "up", "down", "open", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, mark, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                for w in wanted:
                    part = text[w["at"] - w["up"] : w["at"] - w["down"] + length]
                    rows.append((w["gram"], doc, mark, w["at"], w["up"], w["down"], w["open"], part))
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def _pieces(rows: DataFrame, step: int, length: int) -> DataFrame:
    """Runs cut at multiples of ``step`` of the offset, with their new ``bucket`` and the identifier ``own`` of their bytes."""
    first, last = F.floor(F.col("down") / step) * step, F.floor(F.col("up") / step) * step
    cut = rows.withColumn("o", F.explode(F.sequence(first.cast("int"), last.cast("int"), F.lit(step))))
    up, down = F.least(F.col("up"), F.col("o") + step - 1), F.greatest(F.col("down"), F.col("o"))
    part = F.substring("bytes", F.col("up") - up + 1, up - down + length)
    cut = cut.select("bucket", "doc", "mark", "at", up.alias("up"), down.alias("down"), "open", "o", part.alias("bytes"))
    shared = F.substring("bytes", F.col("up") - F.col("o") + 1, F.lit(length - step + 1))
    own = F.xxhash64("up", "down", "bytes")
    return cut.withColumns({"bucket": F.xxhash64("bucket", "o", shared), "own": own}).drop("o")


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc``, ``mark``, ``first``, ``last``: ranges of starts of strings that start elsewhere too.

    ``docs`` has ``doc`` (long), ``mark`` (int; tells rows of one id with different texts apart) and ``text`` (binary).
    """
    spark = docs.sparkSession
    paths = [fresh_path(spark, f"bytes-{i}") for i in range(4 + len(STEPS))]
    runs = stage_at(docs.filter(F.octet_length("text") >= length).mapInArrow(_runs(length, gram), _RUN), paths[0])
    shared = runs.groupBy("gram").agg(F.min("whole").alias("_a"), F.max("whole").alias("_b"), F.count("*").alias("_n"))
    # Sides reduced to a row a bucket are written first: adaptive execution splits the other side of a bucket that very
    # many runs share only where both sides of the join are plain shuffles.
    shared = stage(shared.filter("_n > 1").select("gram", (F.col("_a") != F.col("_b")).alias("mixed")), "grams")
    met = stage_at(runs.join(shared, "gram"), paths[1])
    remove(spark, paths[0])
    start, end = F.col("at") - F.col("up"), F.col("at") - F.col("down")
    ends = ["doc", "mark", start.alias("first"), end.alias("last")]
    settled = [met.filter("NOT mixed").select(*ends)]

    mixed = met.filter("mixed").drop("mixed")
    one = F.min(F.struct("doc", "mark", "at", "up", "down")).alias("one")
    kinds = stage_at(mixed.groupBy("gram", "whole").agg(F.count("*").alias("n"), one), paths[2])
    settled.append(mixed.join(kinds.filter("n > 1").select("gram", "whole"), ["gram", "whole"]).select(*ends))
    undecided = stage(kinds.groupBy("gram").agg(F.min("n").alias("least")).filter("least = 1").select("gram"), "undecided")
    needed = kinds.join(undecided, "gram").select("gram", (F.col("n") == 1).cast("int").alias("open"), "one.*")
    per_text = needed.groupBy("doc", "mark").agg(F.collect_list(F.struct("gram", "at", "up", "down", "open")).alias("wanted"))
    held = docs.join(per_text.hint("shuffle_hash"), ["doc", "mark"]).select("doc", "mark", "text", "wanted")
    shape = "bucket long, doc long, mark int, at int, up int, down int, open int, bytes binary"
    rows = stage_at(held.mapInArrow(_extents(length), shape), paths[3])

    for step, path in zip(STEPS, paths[4:]):
        pieces = stage_at(_pieces(rows, step, length), path)
        first = [F.first(c).alias(c) for c in ("up", "down", "bytes")]
        # A group of one row that is open keeps its place; others are witnesses and need none.
        place = [F.min(c).alias(c) for c in ("doc", "mark", "at")]
        kinds = pieces.groupBy("bucket", "own").agg(F.count("*").alias("n"), F.max("open").alias("open"), *place, *first)
        kinds = kinds.withColumn("open", F.when(F.col("n") == 1, F.col("open")).otherwise(F.lit(0)))
        counts = stage(pieces.groupBy("bucket", "own").agg(F.count("*").alias("n"), F.max("open").alias("open")), "counts")
        twice = counts.filter("n > 1 AND open = 1").select("bucket", "own")
        found = pieces.filter("open = 1").select("bucket", "own", "doc", "mark", "at", "up", "down").join(twice, ["bucket", "own"])
        settled.append(stage(found.select(*ends), "settled"))
        groups = counts.groupBy("bucket").agg(F.count("*").alias("kinds"), F.max(F.expr("int(n = 1 AND open = 1)")).alias("left"))
        left = stage(groups.filter("kinds > 1 AND left = 1").select("bucket"), "left")
        rows = kinds.join(left, "bucket").drop("n", "own")
    return reduce(DataFrame.union, settled)


def _kept(length: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, gone in zip(*(c.to_pylist() for c in batch.columns)):
                kept, spans, at, removed = [], 0, 0, 0
                for first, last in sorted((g["first"], g["last"] + length) for g in gone or ()):
                    if first > at or not spans:
                        kept.append(text[at:first])
                        spans += 1
                        removed += last - first
                        at = last
                    elif last > at:
                        removed += last - at
                        at = last
                rows.append((doc, len(text), removed, spans, b"".join([*kept, text[at:]])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the bytes left) of every row.

    Null text is empty; texts under ``length`` bytes stay whole. Every row counts as a document, also rows that repeat
    an id or have none: the same row twice removes all strings of both.
    """
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    # Rows are told apart by 96 bits of id and text, so null and repeated ids need nothing of their own.
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"))
    rows = rows.withColumns({"doc": F.xxhash64("doc_id", "text"), "mark": F.hash("text")})
    ranges = repeated_starts(rows.select("doc", "mark", "text"), length, gram)
    gone = ranges.groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    gone = stage(gone, "gone").hint("shuffle_hash")
    left = rows.join(gone, ["doc", "mark"], "left").select("doc_id", "text", "gone")
    return left.mapInArrow(_kept(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
