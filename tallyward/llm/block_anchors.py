"""Substring dedup by fixed-block anchors.

A run of ``window`` words is removed where the same run starts in a document with a smaller id. Every such run holds, in
the smaller document, a whole reference block: one of its non-overlapping blocks of ``window // 2`` words. So

1. the reference blocks are indexed and every rolling window of that many words of every document probes the index;
2. a hit is extended over all runs of ``window`` words that contain it, and of each run the smallest id is found;
3. runs with a smaller id than their own document's are removed; overlapping ones make up the maximal repeats.

Probes are the bulk: one for each word of the corpus. They travel packed: a task cuts its probes into buckets by some hash
bits and sends 32 further bits of each, with the ids as differences and run lengths. The number of buckets follows the
bytes of text, so a task's share is the same at every size. In a bucket the index comes first and probes stream past it, so a
task holds the distinct reference blocks of its bucket however often a block occurs. 32 bits and the bucket only choose
candidates; runs are compared by 96 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyward.llm.rolling import BASES, windows, word_hashes
from tallyward.sources.staging import fresh_path, remove, stage, stage_at

WINDOW = 50
BUCKET_BYTES = 16 << 20
# Beyond some 300 GB buckets grow instead: more of them would leave a task's probes a few words a row.
MOST_BUCKETS = 20_000
_FLUSH = 1 << 21
_PROBE = "bucket int, kind int, docs binary, counts binary, sigs binary"


def _codes(items: np.ndarray, block: int, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of each rolling block, as one number."""
    h = windows(items, block)
    return ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _packed(codes: np.ndarray, docs: np.ndarray, kind: int) -> Iterator[tuple]:
    """A row for each bucket, entries in the order of their documents."""
    bucket = codes >> 32
    order = np.argsort(bucket, kind="stable")
    bucket, docs, sigs = bucket[order], docs[order], codes[order].astype(np.uint32)
    for rows in np.split(np.arange(len(order)), np.flatnonzero(np.diff(bucket)) + 1):
        if len(rows):
            a, b = rows[0], rows[-1] + 1
            turns = np.concatenate(([0], np.flatnonzero(np.diff(docs[a:b])) + 1, [b - a]))
            steps = np.diff(docs[a:b][turns[:-1]], prepend=np.int64(0))  # small numbers, which shuffle files compress well
            yield int(bucket[a]), kind, steps.tobytes(), np.diff(turns).astype(np.int32).tobytes(), sigs[a:b].tobytes()


def _batch(rows: list[tuple], schema: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


def _probes(block: int, buckets: int):
    schema = [("bucket", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("sigs", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, docs, size = [], [], 0

        def flush() -> pa.RecordBatch:
            all_codes = np.concatenate([np.empty(0, np.int64), *codes])
            all_docs = np.repeat(np.array(docs, np.int64), [len(c) for c in codes])
            at = np.concatenate([np.empty(0, np.int64), *(np.arange(len(c)) for c in codes)])
            anchors = at % block == 0
            return _batch([*_packed(all_codes[anchors], all_docs[anchors], 0), *_packed(all_codes, all_docs, 1)], schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_numpy(), batch.column(1)):
                got = _codes(word_hashes(text.as_py()), block, buckets)
                if len(got):
                    codes.append(got)
                    docs.append(doc)
                    size += len(got)
                if size >= _FLUSH:
                    yield flush()
                    codes, docs, size = [], [], 0
        yield flush()

    return run


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket, index first: ``doc`` and its codes that hit.

    A probe hits if a smaller document has the block as a reference block. The smallest document that has it so is
    itself a hit if any other document probes with it.
    """
    schema = [("doc", pa.int64()), ("codes", pa.binary())]
    bucket, refs, known, least, most = None, [], None, None, None

    def close() -> list[tuple]:
        if known is None:
            return []
        own = np.flatnonzero(most > least)
        return _by_doc(least[own], known[own].astype(np.int64) | bucket << 32)

    for batch in batches:
        out = []
        for at, kind, docs, counts, sigs in zip(*(c.to_pylist() for c in batch.columns)):
            if at != bucket:
                out += close()
                bucket, refs, known = at, [], None
            ids = np.repeat(np.cumsum(np.frombuffer(docs, np.int64)), np.frombuffer(counts, np.int32))
            sigs = np.frombuffer(sigs, np.uint32)
            if kind == 0:
                refs.append((sigs, ids))
                continue
            if known is None:
                if not refs:
                    continue
                all_sigs, all_ids = (np.concatenate(x) for x in zip(*refs))
                order = np.lexsort((all_ids, all_sigs))
                all_sigs, all_ids = all_sigs[order], all_ids[order]
                first = np.concatenate(([True], all_sigs[1:] != all_sigs[:-1]))
                known, least, refs = all_sigs[first], all_ids[first], []
                most = np.full(len(known), np.iinfo(np.int64).min)
            place = np.minimum(np.searchsorted(known, sigs), len(known) - 1)
            met = known[place] == sigs
            place, ids, sigs = place[met], ids[met], sigs[met]
            np.maximum.at(most, place, ids)
            later = least[place] < ids
            out += _by_doc(ids[later], sigs[later].astype(np.int64) | at << 32)
        yield _batch(out, schema)
    yield _batch(close(), schema)


def _by_doc(docs: np.ndarray, codes: np.ndarray) -> list[tuple]:
    order = np.argsort(docs, kind="stable")
    docs, codes = docs[order], codes[order]
    groups = np.split(np.arange(len(order)), np.flatnonzero(np.diff(docs)) + 1)
    return [(int(docs[g[0]]), codes[g].tobytes()) for g in groups if len(g)]


def _runs(items: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each run of ``window`` items."""
    return windows(items, window).view(np.int64), windows(items, window, BASES[1]).astype(np.uint32).view(np.int32)


def _candidates(window: int, buckets: int):
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, packed in zip(*(c.to_pylist() for c in batch.columns)):
                items = word_hashes(text)
                hit = np.isin(_codes(items, block, buckets), np.frombuffer(b"".join(packed), np.int64))
                first, second = _runs(items, window)
                seen = np.concatenate(([0], np.cumsum(hit)))
                start = np.flatnonzero(seen[window - block + 1 :] > seen[: len(first)])
                found = np.unique(np.rec.fromarrays([first[start], second[start]], names="w,v"))
                ids = np.full(len(found), doc, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found["w"]), pa.array(found["v"]), pa.array(ids)], ["w", "v", "doc"])

    return run


def _kept(window: int):
    schema = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, gone in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.split()
                n = len(words)
                if gone:
                    first, second = _runs(word_hashes(text), window)
                    away = np.array([(g["w"], g["v"]) for g in gone], [("w", np.int64), ("v", np.int32)])
                    start = np.isin(np.rec.fromarrays([first, second], dtype=away.dtype), away)
                    edges = np.zeros(n + 1, np.int64)
                    edges[: len(start)] += start
                    edges[window : window + len(start)] -= start
                    words = [w for w, c in zip(words, np.cumsum(edges[:n]).tolist()) if not c]
                rows.append((doc, n, n - len(words), b" ".join(words)))
            yield _batch(rows, schema)

    return run


def buckets_for(docs: DataFrame, size: int = BUCKET_BYTES, most: int = MOST_BUCKETS) -> int:
    """Buckets of about ``size`` bytes of text: one pass that counts bytes. No bucket count changes a result."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return min(most, max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // size)))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by one space) of every row.

    Null text has no words. Rows with a null id are kept whole and remove nothing. Rows of one id never remove each
    other's words; a run that a smaller id has goes from all of them. Texts under ``window`` words stay whole.
    """
    spark, block = docs.sparkSession, window // 2
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), whole.alias("text"))
    named = rows.filter("doc IS NOT NULL")
    buckets = buckets_for(named)
    packed = named.mapInArrow(_probes(block, buckets), _PROBE)
    met = packed.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_hits, "doc long, codes binary")
    hits = stage(met, "hits").groupBy("doc").agg(F.collect_list("codes").alias("codes"))
    # Hits are hashed, texts stream past them unsorted.
    found = named.join(hits.hint("shuffle_hash"), "doc").select("doc", "text", "codes")
    at = fresh_path(spark, "runs")
    runs = stage_at(found.mapInArrow(_candidates(window, buckets), "w long, v int, doc long"), at)
    least = runs.groupBy("w", "v").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("most > least")
    later = runs.join(least, ["w", "v"]).filter("doc > least")
    gone = stage(later.groupBy("doc").agg(F.collect_list(F.struct("w", "v")).alias("gone")), "gone")
    remove(spark, at)
    left = rows.join(gone.hint("shuffle_hash"), "doc", "left").select("doc", "text", "gone")
    done = left.mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept binary")
    return done.withColumn("kept", F.col("kept").cast("string"))
