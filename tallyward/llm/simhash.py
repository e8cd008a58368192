"""SimHash fingerprints of whole texts (64 bits over word shingles)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyward.llm.marks import MARK, text_mark

SEED = 42
SHINGLE = 3
_BLOCK = 1 << 16


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle (words joined by a space); a shorter text is one shingle, an empty one none.

    ``bytes.split`` and ``bytes.lower`` know ASCII only: white space is 20 and 09 to 0D, case folding is A to Z.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - k + 1)
    last = ends[min(k, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in more than half of the hashes; no hashes give zero. Long texts go in blocks."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        octets = hashes[at : at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(votes * 2 > len(hashes)).tolist()))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """``doc`` (the id), ``mark`` (see ``text_mark``) and ``fp`` (long, the 64 bits) of
    each row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_py() or b"" for x in batch.column("text"))
            bits = np.fromiter((fingerprint(shingle_hashes(t, k)) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("mark"), pa.array(bits.view(np.int64))], ["doc", "mark", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc"), text_mark(F.col(text)).alias("mark"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc {dict(docs.dtypes)[doc_id]}, mark {MARK}, fp long")
