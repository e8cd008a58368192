"""Spelling variants: words one edit apart, found by probing their edits against broadcast Bloom filters.

*Words* are counted in the tasks that read the texts and added up by a shuffle on the word.

*Filters.* The vocabulary is sharded by length (``LAST_SHARD`` letters and more are one shard). Each shard has blocks of 64 bits, a
word sets ``PROBES`` bits of one block. The blocks of all shards, numbered through, are cut into windows of at most ``MOST_BLOCKS``;
one window at a time is sent to the tasks, so what is broadcast has a bound that does not depend on the vocabulary, and only
words with an edit in a window's shards take part in it.

*Edits.* Of two near words one comes from the other by deleting a letter or by putting a later letter in the place of an earlier one,
so only these are made. Their hashes follow from the word's by arithmetic on whole arrays (a polynomial of the letters
modulo 2^64), and strings are made for positives only. These are shuffled to an exact join with the vocabulary, which
removes what the filters let through by mistake; the filters lose nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyward.sources.staging import fresh_path, remove, stage, stage_at

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH = 5
LEAST_COUNT = 3
LAST_SHARD = 64
BITS_A_WORD = 16
PROBES = 4
MOST_BLOCKS = 1 << 22
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_EDITS = 1 << 21
_FLUSH = 200_000
_FLUSH_LETTERS = 1 << 24

Spell = Callable[[str, str], str]


def as_written(doc: str, run: str) -> str:
    return run


def runs_of(text: bytes) -> Counter[str]:
    """How often each run of letters occurs; only A to Z are lower-cased."""
    return Counter(RUN.findall(text.lower().decode("utf-8", "replace")))  # bytes.lower knows ASCII only


def vocabulary(docs: DataFrame, spell: Spell = as_written, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word``, ``n`` (long): the distinct results of ``spell(id as text, run)`` with at least ``LEAST_LENGTH`` letters, and how
    often they occur, if that is ``LEAST_COUNT`` times. Null texts have no runs; a null id is the empty text; repeated rows count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        letters = 0

        def told() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for doc, whole in zip(batch.column("doc").to_pylist(), batch.column("text")):
                for one, n in runs_of(whole.as_py() or b"").items():
                    if len(one) >= LEAST_LENGTH and len(word := spell(doc, one)) >= LEAST_LENGTH:
                        before = counts.get(word, 0)
                        counts[word] = before + n
                        letters += 0 if before else len(word)
                if len(counts) > _FLUSH or letters > _FLUSH_LETTERS:
                    letters = 0
                    yield told()
        yield told()

    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(_BASE))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


class Layout:
    """Where the blocks of each shard begin, from the number of words in each."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.start, self.blocks, self.total = np.zeros(LAST_SHARD + 1, np.int64), np.zeros(LAST_SHARD + 1, np.int64), 0
        for shard in sorted(counts):
            self.start[shard] = self.total
            self.blocks[shard] = max(1, -(-counts[shard] * BITS_A_WORD // 64))
            self.total += int(self.blocks[shard])

    def shard(self, length: int) -> int:
        return min(length, LAST_SHARD)

    def place(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Block number and bits of hashes of words of one length."""
        h, shard = _mixed(h), self.shard(length)
        bits = np.zeros(h.shape, np.uint64)
        for i in range(PROBES):
            bits |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
        # The upper 32 bits are scaled to the shard; a shard of more than 2^32 blocks would only use some of them.
        block = (((h >> np.uint64(32)) * np.uint64(self.blocks[shard])) >> np.uint64(32)).astype(np.int64)
        return block + self.start[shard], bits

    def meets(self, length: int, low: int, high: int) -> bool:
        shard = self.shard(length)
        return bool(self.blocks[shard]) and self.start[shard] < high and self.start[shard] + self.blocks[shard] > low


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    yield from ((int(lengths[g[0]]), g) for g in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(g))


def _slices(rows: np.ndarray, size: int) -> list[np.ndarray]:
    """``rows`` in slices of about ``_EDITS`` numbers where a row has ``size``."""
    step = max(1, _EDITS // max(1, size))
    return [rows[at : at + step] for at in range(0, len(rows), step)]


def _filled(vocab: DataFrame, layout: Layout) -> DataFrame:
    """``block``, ``bits`` of all filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, rows in _by_length(words):
                for part in _slices(rows, length):
                    codes = _codes([words[i] for i in part])
                    block, bits = layout.place((codes * _powers(length)).sum(axis=1, dtype=np.uint64), length)
                    yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(bits.view(np.int64))], ["block", "bits"])

    return vocab.select("word").mapInArrow(run, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits"))


def _letters_used(vocab: DataFrame) -> str:
    """The letters of ``LETTERS`` in any word: at most as many as there are."""
    held = [F.max(F.contains("word", F.lit(c))).alias(f"l{i}") for i, c in enumerate(LETTERS)]
    found = vocab.agg(*held).first()
    return "".join(c for i, c in enumerate(LETTERS) if found[i])


def probed(words: list[str], letters: str, layout: Layout, low: int, window: np.ndarray) -> Iterator[tuple[int, str]]:
    """(place of the word, edit) of each edit that the filter blocks ``low`` and on (``window``) may hold."""
    high = low + len(window)
    later = [np.array([ord(c) for c in letters if ord(c) > p], np.uint64) for p in range(0x100)]
    for length, rows in _by_length(words):
        shorter, same = layout.meets(length - 1, low, high), layout.meets(length, low, high)
        if not shorter and not same:
            continue
        powers = _powers(length)
        for part in _slices(rows, length * len(letters)):
            codes = _codes([words[i] for i in part])
            terms = codes * powers
            ends = np.add.accumulate(terms, axis=1)
            total = ends[:, -1:]

            def positive(h: np.ndarray, size: int) -> np.ndarray:
                block, bits = layout.place(h, size)
                inside = (block >= low) & (block < high)
                held = window[np.where(inside, block - low, 0)]
                return inside & ((held & bits) == bits)

            if shorter:
                gone = ends - terms + (total - ends) * np.uint64(_INVERSE)
                found = positive(gone, length - 1)
                found[:, 1:] &= codes[:, 1:] != codes[:, :-1]  # deleting either of two equal neighbours is one edit
                for i, at in zip(*(x.tolist() for x in np.nonzero(found))):
                    word = words[part[i]]
                    yield int(part[i]), word[:at] + word[at + 1 :]
            if same:
                for old in np.unique(codes).tolist():
                    new = later[old]
                    if not len(new):
                        continue
                    i, at = np.nonzero(codes == old)
                    step = max(1, _EDITS // len(new))
                    for k in range(0, len(i), step):
                        some, place = i[k : k + step], at[k : k + step]
                        h = total[some] + (new - np.uint64(old))[None, :] * powers[place][:, None]
                        for j, c in zip(*(x.tolist() for x in np.nonzero(positive(h, length)))):
                            word, p = words[part[some[j]]], int(place[j])
                            yield int(part[some[j]]), word[:p] + chr(int(new[c])) + word[p + 1 :]


def _positives(vocab: DataFrame, letters: str, layout: Layout, low: int, window: np.ndarray) -> DataFrame:
    """``word``, ``n``, ``edit`` for one window of the filters."""
    sent = vocab.sparkSession.sparkContext.broadcast(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1)
            rows, edits = [], []

            def told() -> pa.RecordBatch:
                of = pa.array(rows, pa.int64())
                made = pa.RecordBatch.from_arrays([batch.column(0).take(of), n.take(of), pa.array(edits, pa.string())], ["word", "n", "edit"])
                rows.clear(), edits.clear()
                return made

            held = 0
            for row, edit in probed(words, letters, layout, low, sent.value):
                rows.append(row)
                edits.append(edit)
                held += len(edit)
                if held > _FLUSH_LETTERS:
                    held = 0
                    yield told()
            yield told()

    return vocab.select("word", "n").mapInArrow(run, "word string, n long, edit string")


def near_words(vocab: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n``: every two words of ``vocab`` (``word`` of letters in ``LETTERS``, distinct, and ``n``) that
    differ by one inserted, deleted or replaced letter; each pair both ways round."""
    shard = F.least(F.length("word"), F.lit(LAST_SHARD)).alias("shard")
    layout = Layout({r["shard"]: r["count"] for r in vocab.groupBy(shard).count().collect()})
    spark, letters, found = vocab.sparkSession, _letters_used(vocab), None
    blocks = stage(_filled(vocab, layout), "filters")
    for low in range(0, max(1, layout.total), most_blocks):
        size = min(most_blocks, layout.total - low)
        held = blocks.filter((F.col("block") >= low) & (F.col("block") < low + size)).toArrow()
        window = np.zeros(max(1, size), np.uint64)
        window[held.column("block").to_numpy() - low] = held.column("bits").to_numpy().view(np.uint64)
        part = _positives(vocab, letters, layout, low, window)
        found = part if found is None else found.union(part)
    known = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = stage(found.withColumnRenamed("edit", "near").join(known, "near").select("word", "n", "near", "near_n"), "near")
    return pairs.union(pairs.select(F.col("near"), F.col("near_n"), F.col("word"), F.col("n")))


def roots(links: DataFrame) -> DataFrame:
    """``word``, ``root`` for links (``word``, ``form``) without cycles, by doubling: each round, a word takes its root's root."""
    spark, at = links.sparkSession, fresh_path(links.sparkSession, "roots")
    now = stage_at(links.select("word", F.col("form").alias("root")), at)
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        path = fresh_path(spark, "roots")
        then = stage_at(now.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), path)
        moved = not then.filter("moved").isEmpty()
        remove(spark, at)
        now, at = then.select("word", "root"), path
        if not moved:
            return now


def variants(vocab: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for every word of ``vocab`` (``word``, ``n``).

    A word's form is its near word with the largest count (ties: the first in code-point order) if that is at least twice
    the word's; its root is where the forms end. Words without near words have none, and are their own root. An empty
    vocabulary gives an empty result.
    """
    vocab = stage(vocab.select("word", "n"), "vocabulary")
    alone = vocab.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct(-F.col("near_n"), F.col("near")))).alias("best")
    rows = alone.union(near_words(vocab, most_blocks)).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best)
    leads = -F.col("best.col1") >= 2 * F.col("n")
    rows = rows.select("word", "n", "n_near", *(F.when(leads, c).alias(a) for c, a in ((F.col("best.near"), "form"), (-F.col("best.col1"), "form_n"))))
    rows = stage(rows, "forms")
    found = rows.join(roots(rows.filter("form IS NOT NULL").select("word", "form")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def misspelt(doc: str, run: str) -> str:
    """The run without one letter where a checksum of id and run says so (one in 97)."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    return run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
