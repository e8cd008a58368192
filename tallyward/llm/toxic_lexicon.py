"""Toxicity by a weighted lexicon: Aho-Corasick over folded words, exception phrases, normalised by length.

*Folding.* Case goes, look-alike letters of other scripts become Latin ones, invisible characters go, and digits and signs
that stand for letters (``1d1ot``, ``id!ot``) become these where letters are next to them. What is left are words of letters,
joined by single spaces.

*Lexicon.* An entry is a whole word (`` idiot ``) or the start of words (`` idio``); a word counts once, with its heaviest
entry. Words inside an exception phrase do not count. The sum of weights is divided by the number of words (and ``PRIOR``
more, so that one hit in a short text is no proof), and a logistic curve turns it into a score.

*Learning.* Entries and weights are smoothed log odds of holding the entry, between toxic and clean texts. They are counted by
Spark on a bounded sample: at most ``SAMPLE`` distinct texts of each label, chosen by a hash; the curve is fitted on the
other half of that sample. Exceptions are word pairs around an entry that clean texts hold more often than toxic ones. At most
``MOST_ENTRIES`` entries and as many exceptions come to the driver. Everything else covers all texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyward.sources.staging import stage

SAMPLE = 3000
MOST_ENTRIES = 4000
STARTS = (4, 5, 6, 7, 8)
LEAST_DOCS = 3
LEAST_WEIGHT = 2.2
LEAST_SURPRISE = 16.0
PRIOR = 20
_FLUSH = 200_000
_BITS = 1 << 30

# Letters that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ё": "e", "ї": "i", "г": "r",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ω": "w", "γ": "y", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "£": "l"}

_LETTERS = {ord(k): v for k, v in LOOK_ALIKES.items()} | dict.fromkeys(map(ord, INVISIBLE))
_LETTERS |= {0xFF00 + i: chr(0x20 + i).lower() for i in range(1, 0x5F)}  # full-width forms
_DIGITS = str.maketrans(DIGITS)
_SIGN = re.compile(r"[@$!|€£](?<=[^\W\d_].)(?=[^\W\d_])")
_DIGIT_RUN = re.compile(r"[0-9]+")
_ODD = re.compile(f"[{re.escape(''.join(map(chr, _LETTERS)))}]")
_WORD = re.compile(r"[^\W\d_]+")


def _as_letters(run: re.Match) -> str:
    """Digits next to a letter as letters, others as a space."""
    before, after = run.string[max(0, run.start() - 1) : run.start()], run.string[run.end() : run.end() + 1]
    return run[0].translate(_DIGITS) if before.isalpha() or after.isalpha() else " "


def folded(text: str) -> str:
    """The words of ``text``, folded, joined by spaces, with a space before the first and after the last."""
    plain = text.lower()
    if not plain.isascii():
        plain = _ODD.sub(lambda m: _LETTERS[ord(m[0])] or "", plain)
    plain = _SIGN.sub(lambda m: SIGNS[m[0]], plain)
    plain = _DIGIT_RUN.sub(_as_letters, plain)
    words = _WORD.findall(plain)
    return f" {' '.join(words)} " if words else ""


@dataclass
class Lexicon:
    """``entries``: weight of each `` word `` or `` start``; ``exceptions``: phrases of words with a space at both ends.
    ``curve``: intercept and slope of the logistic curve."""

    entries: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float] = (-4.0, 2.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        made = ahocorasick.Automaton()
        for phrase in self.exceptions:
            made.add_word(phrase, (len(phrase), None))
        for entry, weight in self.entries.items():
            if entry not in made:  # a phrase that is both is an exception
                made.add_word(entry, (len(entry), weight))
        if not len(made):
            return None
        made.make_automaton()
        return made


def hits(plain: str, automaton: ahocorasick.Automaton | None) -> dict[int, float]:
    """By the place of a matched word's first letter in the folded text: the heaviest weight of its entries, unless an
    exception phrase covers the word."""
    found: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(plain) if automaton and plain else ():
        at = end - length + 2
        if weight is None:
            spared.append((at, end))
        else:
            found[at] = max(weight, found.get(at, weight))
    for start, end in spared:  # a phrase is short, so few places lie in it
        for at in range(start, end):
            found.pop(at, None)
    return found


def heat(plain: str, automaton: ahocorasick.Automaton | None) -> float:
    """Logarithm of the summed weights for a hundred words (``PRIOR`` words more than there are)."""
    total = sum(hits(plain, automaton).values())
    return math.log1p(100 * total / (max(0, plain.count(" ") - 1) + PRIOR))


def curve_value(x: float, curve: tuple[float, float]) -> float:
    z = curve[0] + curve[1] * x
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one feature with a small ridge, by Newton's steps; the slope is never negative."""
    rows, b = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ b, -30, 30)))
        slope = rows.T @ (weight * (y - p)) - 0.01 * b
        bend = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 0.01 * np.eye(2)
        move = np.linalg.solve(bend, slope)
        b = b + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return float(b[0]), max(0.0, float(b[1]))


def candidates(plain: str) -> set[str]:
    """Every entry that a folded text could support: its words, and their starts of the lengths in ``STARTS``."""
    words = set(plain.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STARTS if len(w) > n}


def pairs_at_hits(plain: str, automaton: ahocorasick.Automaton | None) -> set[str]:
    """The word pairs (before and after) that hold a matched word."""
    out = set()
    for at in hits(plain, automaton):
        end = plain.index(" ", at)
        before, after = plain.rfind(" ", 0, at - 1), plain.find(" ", end + 1)
        if before >= 0:
            out.add(plain[before : end + 1])
        if after >= 0:
            out.add(plain[at - 1 : after + 1])
    return out


def surprise(toxic, clean, share: float, log):
    """Likelihood ratio statistic of ``toxic`` and ``clean`` texts where a share of ``share`` is toxic; for numbers and columns."""
    n = toxic + clean
    return 2 * (toxic * log((toxic + 1e-9) / (n * share)) + clean * log((clean + 1e-9) / (n * (1 - share))))


def log_odds(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))


def labelled_sample(docs: DataFrame, labels: DataFrame, keep: Column, doc_id: str, text: str, label: str) -> tuple[DataFrame, dict[int, int]]:
    """``h``, ``text``, ``toxic`` of at most ``SAMPLE`` distinct texts of each label among the rows that ``keep`` allows, and
    how many distinct texts there are of each. A text with both labels is toxic.

    Only ids and hashes are joined and shuffled; the chosen hashes (two times ``SAMPLE`` at most) go to the texts.
    """
    spark, h = docs.sparkSession, F.xxhash64(text)
    usable = docs.filter(keep & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    marks = usable.select(F.col(doc_id).alias("id"), h.alias("h"))
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("toxic"))
    texts = stage(marks.join(known, "id").groupBy("h").agg(F.max("toxic").alias("toxic")), "labelled")
    counts = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    order, picked = F.xxhash64("h", F.lit("sample")), []
    for toxic, n in sorted(counts.items()):
        # About twice the sample passes the first test, so little is left to sort.
        some = texts.filter((F.col("toxic") == toxic) & (F.pmod(order, F.lit(_BITS)) < int(_BITS * min(1.0, 2 * SAMPLE / n)) + 1))
        picked += [(r["h"], toxic) for r in some.orderBy(F.pmod(order, F.lit(_BITS)), "h").limit(SAMPLE).collect()]
    chosen = F.broadcast(spark.createDataFrame(picked, "h long, toxic int"))
    rows = usable.select(h.alias("h"), F.col(text).alias("text")).join(chosen, "h")
    return stage(rows.groupBy("h").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")), "sample"), counts


def _counted(sample: DataFrame, found) -> DataFrame:
    """``entry``, ``toxic``, ``clean``: how many texts of each label hold what ``found(folded text)`` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def told() -> pa.RecordBatch:
            n = np.array(list(counts.values()), np.int64).reshape(-1, 2)
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(n[:, 1]), pa.array(n[:, 0])], ["entry", "toxic", "clean"])
            counts.clear()
            return made

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                for entry in found(folded(text.as_py())):
                    counts.setdefault(entry, [0, 0])[toxic] += 1
                if len(counts) > _FLUSH:
                    yield told()
        yield told()

    rows = sample.select("text", "toxic").mapInArrow(run, "entry string, toxic long, clean long")
    return rows.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(
    docs: DataFrame, labels: DataFrame, keep: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"
) -> Lexicon | None:
    """The lexicon for the rows of ``docs`` that ``keep`` allows and that have a label; None if there is none of both kinds."""
    sample, counts = labelled_sample(docs, labels, keep, doc_id, text, label)
    if set(counts) != {0, 1}:
        return None
    first = F.pmod(F.xxhash64("h", F.lit("half")), F.lit(2)) == 0
    totals = Counter({r["toxic"]: r["count"] for r in sample.filter(first).groupBy("toxic").count().collect()})
    odds = F.log((F.col("toxic") + 0.5) / (totals[1] + 1)) - F.log((F.col("clean") + 0.5) / (totals[0] + 1))
    heavy = _counted(sample.filter(first), candidates).filter((F.col("toxic") >= LEAST_DOCS) & (odds >= LEAST_WEIGHT))
    heavy = heavy.filter(surprise(F.col("toxic"), F.col("clean"), totals[1] / (totals[0] + totals[1]), F.log) >= LEAST_SURPRISE)
    best = heavy.orderBy(F.desc(F.col("toxic") * odds), "entry").limit(MOST_ENTRIES).collect()
    entries = {r["entry"]: log_odds(r["toxic"], r["clean"], totals[1], totals[0]) for r in best}
    lexicon = Lexicon(entries)
    if entries:
        around = _counted(sample.filter(first), lambda plain, made=lexicon: pairs_at_hits(plain, _made(made)))
        spared = around.filter((F.col("clean") >= LEAST_DOCS) & (F.col("clean") * totals[1] > F.col("toxic") * totals[0]))
        lexicon.exceptions = [r["entry"] for r in spared.orderBy(F.desc("clean"), "entry").limit(MOST_ENTRIES).collect()]
    rest = _heats(sample.filter(~first).select("text", "toxic"), lexicon, ["toxic"]).toPandas()
    if set(rest["toxic"]) == {0, 1}:
        seen = rest["toxic"].value_counts()
        y = rest["toxic"].to_numpy(np.float64)
        lexicon.curve = fit_curve(rest["_heat"].to_numpy(), y, np.where(y == 1, counts[1] / seen[1], counts[0] / seen[0]))
    return lexicon


_AUTOMATA: dict[int, tuple[Lexicon, ahocorasick.Automaton | None]] = {}


def _made(lexicon: Lexicon) -> ahocorasick.Automaton | None:
    """The automaton of a lexicon, built once in a Python worker."""
    if id(lexicon) not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[id(lexicon)] = (lexicon, lexicon.automaton())
    return _AUTOMATA[id(lexicon)][1]


def _heats(docs: DataFrame, lexicon: Lexicon, columns: list[str], text: str = "text", name: str = "_heat") -> DataFrame:
    rows = docs.select(*columns, F.col(text).alias("_plain_text"))
    shape = StructType([*docs.select(*columns).schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            values = [heat(folded(t.as_py() or ""), automaton) for t in batch.column(len(columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.float64())], [*columns, name])

    return rows.mapInArrow(run, shape)


def scores(docs: DataFrame, lexicon: Lexicon | None, columns: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """``columns`` of every row with ``name``, the score from 0 to 1. Only the text is looked at.

    Null and empty texts have no hits and get the score of any text without hits. Without a lexicon all scores are 0.
    """
    if lexicon is None:
        return docs.select(*columns, F.lit(0.0).alias(name))
    z = F.lit(lexicon.curve[0]) + F.lit(lexicon.curve[1]) * F.col("_heat")
    return _heats(docs, lexicon, columns, text).select(*columns, (1 / (1 + F.exp(-z))).alias(name))
