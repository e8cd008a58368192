"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. The character span of each token is mapped from the byte lengths of the
vocabulary, and the spans are joined to the sections of the document by interval: a section gets the tokens that an
explicit rule allocates to it where a token crosses a boundary:

``first``   the section that holds the token's first character (a character belongs to its first byte)
``last``    the section that holds its last character
``share``   each section, in proportion to the characters of the token that lie in it

The join runs on prefix sums of the weight that the rule puts on each character, so its cost is one pass over the tokens
and two look-ups a section, and sections may overlap or leave gaps. Where they tile the text the counts add up to the
tokens of the document.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_VOCABULARY_BYTES = 64 << 20
# Fixed value: the split pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "last", "share")

Sections = Callable[[str], list[tuple[int, int]]]


def lines(text: str) -> list[tuple[int, int]]:
    """A section for each line, its line feed included; an empty text has none."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return list(zip([0, *ends[:-1]], ends))


class Encoder:
    """A byte-level BPE with the byte length of each token."""

    def __init__(self, vocabulary: bytes) -> None:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(token) for token in ranks]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and last character (inclusive) of each token."""
        tokens = np.array(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.lengths[tokens])
        octets = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((octets & 0xC0) != 0x80) - 1
        return character[ends - self.lengths[tokens]], character[ends - 1]


def weights(first: np.ndarray, last: np.ndarray, n_chars: int, rule: str) -> np.ndarray:
    """Prefix sums, by character, of the weight that ``rule`` gives each character."""
    if rule == "share":
        width = last - first + 1
        edges = np.zeros(n_chars + 1)
        np.add.at(edges, first, 1 / width)
        np.add.at(edges, last + 1, -1 / width)
        per_char = np.cumsum(edges[:-1])
    else:
        per_char = np.bincount(first if rule == "first" else last, minlength=n_chars)
    return np.concatenate(([0], np.cumsum(per_char)))


def section_counts(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    rule: str = "first",
    sections: Sections = lines,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id``, ``section`` (from 0), ``start``, ``end`` (characters), ``n_tokens`` (double under ``share``).

    Null and empty texts have no sections and give no rows; repeated rows give theirs each. The vocabulary is read once
    and sent to the tasks if it is not larger than ``MOST_VOCABULARY_BYTES``.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(docs.sparkSession, vocabulary))
    kind, arrow = ("double", pa.float64()) if rule == "share" else ("long", pa.int64())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batches:
            sizes, number, starts, ends, counts = [], [], [], [], []
            for value in batch.column(1):
                whole = value.as_py()
                spans = np.array(sections(whole), np.int64).reshape(-1, 2)
                sums = weights(*encoder.spans(whole), len(whole), rule)
                sizes.append(len(spans))
                number.append(np.arange(len(spans)))
                starts.append(spans[:, 0])
                ends.append(spans[:, 1])
                counts.append(sums[spans[:, 1]] - sums[spans[:, 0]])
            if sizes:
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                values = [pa.array(np.concatenate(c).astype(np.int64)) for c in (number, starts, ends)]
                values.append(pa.array(np.concatenate(counts), arrow, safe=False))
                yield pa.RecordBatch.from_arrays([ids, *values], ["doc_id", "section", "start", "end", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, section long, start long, end long, n_tokens {kind}")


def read_vocabulary(spark: SparkSession, path: str) -> bytes:
    found = spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("length", "content")
    length = found.select("length").first()[0]
    if length > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {length} bytes; at most {MOST_VOCABULARY_BYTES} are sent to tasks")
    return bytes(found.first()["content"])
