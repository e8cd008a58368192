"""Language identification by a byte convolutional network, trained and applied in numpy.

The network sees windows of ``WINDOW`` bytes: convolutions of several widths over one-hot bytes, the maximum of each
filter over the window, a rectifier, and a softmax over the languages. A convolution over one-hot bytes is a sum of table
rows, one table for each place under the filter. A text is cut into windows from end to end; the windows' probabilities
are averaged by their bytes.

Training fits on a bounded sample: at most ``SAMPLE_DOCS`` documents of each language, chosen by a hash of the id, and at
most ``SAMPLE_WINDOWS`` windows of each, spread over the whole text. Everything else covers all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tallyward.sources.staging import stage

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 3
EPOCHS = 4
BATCH = 64
RATE = 0.01
UNKNOWN = "und"
_ROWS = 64
_SHARE_BYTES = 1 << 20
_PLACES = 1 << 30


@dataclass
class Network:
    """``tables[i][j]``: 256 x FILTERS for place j under the filters of width i. Byte 0 pads, its rows are zero."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        tables = [rng.normal(0, 0.3 / w**0.5, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        for t in tables:
            t[:, 0] = 0
        dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        return cls(languages, tables, np.zeros(len(dense), np.float32), dense, np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, self.bias, self.dense, self.dense_bias]

    def _peaks(self, data: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        tops, places = [], []
        for table in self.tables:
            w = len(table)
            n = data.shape[1] - w + 1
            total = table[0][data[:, :n]]
            for j in range(1, w):
                total += table[j][data[:, j : j + n]]
            place = total.argmax(axis=1)
            places.append(place)
            tops.append(np.take_along_axis(total, place[:, None], 1)[:, 0])
        return np.concatenate(tops, axis=1), places

    def step(self, data: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Gradients of the cross entropy; only the peak of each filter takes part in a convolution's."""
        tops, places = self._peaks(data)
        active = np.maximum(tops + self.bias, 0)
        error = softmax(active @ self.dense + self.dense_bias)
        error[np.arange(len(labels)), labels] -= 1
        error /= len(labels)
        back = (error @ self.dense.T) * (active > 0)
        grads, rows = [], np.arange(len(data))[:, None]
        for i, (table, place) in enumerate(zip(self.tables, places)):
            grad, part = np.zeros_like(table), back[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(len(table)):
                np.add.at(grad[j], (data[rows, place + j], np.arange(FILTERS)[None, :]), part)
                grad[j, 0] = 0
            grads.append(grad)
        return [*grads, back.sum(axis=0), active.T @ error, error.sum(axis=0)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Applied:
    """A network for prediction, with the tables of neighbouring places combined into tables of byte pairs."""

    def __init__(self, net: Network) -> None:
        self.net = net
        pair = lambda t, j: (t[j][:, None] + t[j + 1][None]).reshape(65536, -1)
        self.parts = [[(j, pair(t, j)) if j + 1 < len(t) else (j, t[j]) for j in range(0, len(t), 2)] for t in net.tables]

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Probabilities of each window (rows of bytes, padded with 0)."""
        out = []
        for at in range(0, len(data), _ROWS):
            part = data[at : at + _ROWS].astype(np.int32)
            pairs = part[:, :-1] * 256 + part[:, 1:]
            tops = []
            for tables, full in zip(self.parts, self.net.tables):
                n = data.shape[1] - len(full) + 1
                total = None
                for j, table in tables:
                    rows = table.take((pairs if len(table) > 256 else part)[:, j : j + n], axis=0)
                    total = rows if total is None else np.add(total, rows, out=total)
                tops.append(total.max(axis=1))
            out.append(softmax(np.maximum(np.concatenate(tops, axis=1) + self.net.bias, 0) @ self.net.dense + self.net.dense_bias))
        return np.concatenate(out)

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of each text, of which none is empty; windows of many texts share batches."""
        counts = np.array([-(-len(t) // WINDOW) for t in texts])
        data = np.frombuffer(b"".join(t.ljust(int(c) * WINDOW, b"\0") for t, c in zip(texts, counts)), np.uint8)
        p = self.windows(data.reshape(-1, WINDOW))
        weight = np.full(len(p), float(WINDOW))
        weight[np.cumsum(counts) - 1] = [len(t) - (int(c) - 1) * WINDOW for t, c in zip(texts, counts)]
        starts = np.cumsum(counts) - counts
        return np.add.reduceat(p * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]


def fit(texts: list[bytes], labels: list[str], seed: int = 1) -> Network:
    """Train on windows of labelled texts by Adam; the same rows in the same order give the same network."""
    languages = sorted(set(labels))
    net = Network.fresh(languages, seed)
    data = np.frombuffer(b"".join(t[:WINDOW].ljust(WINDOW, b"\0") for t in texts), np.uint8).reshape(-1, WINDOW)
    target = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    parameters = net.parameters()
    means, squares, turn = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            turn += 1
            for p, g, m, v in zip(parameters, net.step(data[rows], target[rows]), means, squares):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return net


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_rows(docs: DataFrame, keep: Column, doc_id: str, text: str, lang: str) -> DataFrame:
    """``lang`` and windows of text (binary) of the bounded sample; rows that repeat an id and text count once."""
    usable = docs.filter(keep & F.col(lang).isNotNull() & has_letter(F.col(text)))
    rows = usable.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"))
    h, place = F.xxhash64("id", "text").alias("h"), F.pmod("h", F.lit(_PLACES))
    known = stage(rows.select("lang", h).distinct(), "training")
    # About twice the sample passes the first test, so a language's rank sees little more than the sample.
    sizes = known.groupBy("lang").agg((F.lit(2.0 * SAMPLE_DOCS * _PLACES) / F.count("*") + 1).alias("most"))
    # A row a language, of which the network has an output for each.
    some = known.join(F.broadcast(sizes), "lang").filter(place <= F.col("most"))
    order = Window.partitionBy("lang").orderBy(place, "h")
    chosen = some.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SAMPLE_DOCS)
    # At most SAMPLE_DOCS small rows a language, so they are sent to the texts and not the texts to them.
    sent = F.broadcast(chosen.select("h", "lang"))
    picked = rows.withColumn("h", h).join(sent, ["h", "lang"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    size = F.octet_length("text")
    steps = F.transform(
        F.sequence(F.lit(0), F.least(F.lit(SAMPLE_WINDOWS - 1), F.floor((size - 1) / WINDOW).cast("int"))),
        lambda k: F.substring("text", (k * F.floor(size / SAMPLE_WINDOWS) + 1).cast("int"), F.lit(WINDOW)),
    )
    return picked.select("lang", "h", F.posexplode(steps).alias("k", "part")).orderBy("lang", "h", "k").select("lang", "part")


def train(docs: DataFrame, keep: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """The network for the rows that ``keep`` allows; None if no such row has a language and a letter."""
    sample = training_rows(docs, keep, doc_id, text, lang).toArrow()
    if not sample.num_rows:
        return None
    return fit(sample.column("part").to_pylist(), sample.column("lang").to_pylist())


def _shares(texts: pa.Array, rows: np.ndarray) -> list[np.ndarray]:
    """``rows`` cut where their texts pass each multiple of ``_SHARE_BYTES``, so that copies in a task stay small."""
    if not len(rows):
        return []
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)[rows])
    return np.split(rows, np.flatnonzero(np.diff(sizes // _SHARE_BYTES)) + 1)


def predict(
    docs: DataFrame, net: Network | None, columns: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``columns`` of every row with ``lang_pred`` and ``score`` (the mean probability of that language).

    Null texts and texts without a letter are ``und`` with score 0. Only the text is looked at. ``names`` renames the new
    columns where ``columns`` has the same.
    """
    rows = docs.select(*columns, F.col(text).cast("binary").alias("_text"), has_letter(F.col(text)).alias("_letter"))
    shape = StructType([*docs.select(*columns).schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        applied = Applied(net) if net else None
        for batch in batches:
            letter = batch.column(len(columns) + 1).to_numpy(zero_copy_only=False)
            best, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            known = np.flatnonzero(letter) if applied else np.empty(0, np.int64)
            for rows in _shares(batch.column(len(columns)), known):
                p = applied.texts([batch.column(len(columns))[int(i)].as_py() for i in rows])
                score[rows] = np.minimum(p.max(axis=1), 1)
                for i, k in zip(rows, p.argmax(axis=1)):
                    best[i] = applied.net.languages[k]
            out = [*batch.columns[: len(columns)], pa.array(best, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(out, [*columns, *names])

    return rows.mapInArrow(run, shape)
