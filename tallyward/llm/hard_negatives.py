"""Hard negatives: an inverted multi-index over two half spaces, visited in the order of certified bounds.

Vectors are cut into two halves; each half has a codebook (k-means on a bounded sample, at most ``SAMPLE`` rows), and a row
lies in the cell of its two codes. A row's score with an anchor is the sum of two half scores, and in a cell each is at most
the codeword's plus the length of the anchor's half times the codeword's radius. So a multi-sequence heap over the two
sorted lists of these half bounds yields cells by falling bound, and the search of an anchor ends when what it wants is
certain: the bound is below the last score kept (positives), or below what every window still lacks (negatives). Cells that
lie wholly above all windows are left out by the lower bounds of the same kind. Results are exact, whatever the codebooks.

On Spark: cells are put together, and large ones cut by a hash of the id, into parts of about ``PART_ROWS`` rows. An anchor
first searches the part with the best bound; what it finds there decides which other parts it goes to. Rows and anchors meet
by a shuffle on the part, rows first, so a task holds one part and one batch of anchors. Positives come first; their
scores make the windows of the second search, which goes the same two steps.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyward.sources.staging import stage

SCALE = 256
LOW, HIGH = 50, 95  # percent of the positive's score
POSITIVES = 5
NEGATIVES = 3
SAMPLE = 16384
ROUNDS = 8
CELL_ROWS = 256
MOST_CODES = 256
PART_ROWS = 16384
_WAVE = 256
_NONE = -(1 << 63)
_SHAPE = "part long, kind int, id long, label int, v array<long>, wanted array<long>, scores array<long>, least array<long>"


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(SCALE * x))


def usable(rows: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """``id``, ``label``, ``v`` (whole numbers), ``dims``; one row an id.

    Rows without id, label or vector, or with a null or non-finite component, are left out. So are vectors whose
    products might not fit a long: components beyond the root of 2^63 / dimension. Of rows that share an id the first
    by label and vector counts. A vector without components scores 0 with its like.
    """
    size = F.greatest(F.size("x"), F.lit(1))
    most = F.sqrt(F.lit(float(1 << 63)) / size) - 2
    fit = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(SCALE * x) < most))
    named = rows.select(F.col(vec_id).cast("long").alias("id"), label.cast("int").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    good = named.filter("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(fit)
    first = good.groupBy("id").agg(F.min(F.struct("label", F.transform("x", lambda x: F.floor(SCALE * x)).alias("v"))).alias("first"))
    return first.select("id", "first.label", "first.v", F.size("first.v").alias("dims"))


def fit_codes(rows: np.ndarray, codes: int) -> np.ndarray:
    """Centres of ``rows`` by a few rounds of k-means from spread rows; never more than distinct rows."""
    distinct = np.unique(rows, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(codes, len(distinct))).astype(int)].copy()
    for _ in range(ROUNDS):
        code = nearest_code(rows, centres)
        n = np.bincount(code, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, code, rows)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest_code(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * rows @ centres.T).argmin(axis=1)


class Halves:
    """The two codebooks; a vector of one component (or none) has an empty half, on which all codes are 0."""

    def __init__(self, sample: np.ndarray, codes: int) -> None:
        self.cut = (sample.shape[1] + 1) // 2
        self.books = [fit_codes(h, codes) if h.shape[1] else np.zeros((1, 0)) for h in self.split(sample)]

    def split(self, rows: np.ndarray) -> list[np.ndarray]:
        return [rows[:, : self.cut], rows[:, self.cut :]]

    def codes(self, rows: np.ndarray) -> list[np.ndarray]:
        return [nearest_code(h, b) for h, b in zip(self.split(rows), self.books)]

    def spread(self, rows: np.ndarray, codes: list[np.ndarray]) -> list[np.ndarray]:
        """Distance of each row's half to its codeword, a little enlarged against rounding."""
        return [np.sqrt(((h - b[c]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-9 for h, b, c in zip(self.split(rows), self.books, codes)]

    def bounds(self, queries: np.ndarray, radii: list[np.ndarray], sign: int = 1) -> list[np.ndarray]:
        """Per half, query and code: the largest half score (``sign`` 1), or the smallest (-1), of a row with that code.
        Radii below 0 stand for codes without rows. What rounding may take is added."""
        out = []
        for half, book, radius in zip(self.split(queries), self.books, radii):
            length = np.sqrt((half * half).sum(axis=1))[:, None]
            middle = half @ book.T
            slack = 1e-9 * (1 + np.abs(middle) + length * np.abs(radius)[None, :])
            reach = np.where(radius[None, :] < 0, -np.inf, length * radius[None, :] + slack)
            out.append(middle + sign * reach if sign > 0 else np.where(radius[None, :] < 0, np.inf, middle - reach))
        return out


def visits(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Multi-sequence order: (sum, place in ``first``, place in ``second``) of all finite pairs, by falling sum."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    heap = [(-(x[0] + y[0]), 0, 0)] if x and y else []
    while heap:
        total, i, j = heapq.heappop(heap)
        if total == np.inf:
            return
        yield -total, int(a[i]), int(b[j])
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


class Cells:
    """Rows in the order of their cells, ready to be visited."""

    def __init__(self, halves: Halves, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        self.halves = halves
        codes = halves.codes(rows.astype(np.float64))
        n = len(halves.books[1])
        order = np.lexsort((ids, labels, codes[0] * n + codes[1]))
        self.ids, self.labels, rows = ids[order], labels[order], rows[order]
        codes = [c[order] for c in codes]
        cell = codes[0] * n + codes[1]
        edges = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
        self.at = {(int(cell[s]) // n, int(cell[s]) % n): (int(s), int(e)) for s, e in zip(edges[:-1], edges[1:])}
        self.radii = []
        for c, far, book in zip(codes, halves.spread(rows.astype(np.float64), codes), halves.books):
            radius = np.full(len(book), -1.0)
            np.maximum.at(radius, c, far)
            self.radii.append(radius)
        # Doubles are exact below 2^53; what lies beyond is added up in whole numbers.
        self.most = float(np.abs(rows).max(initial=0))
        self.rows, self.wide = rows.astype(np.float64), rows

    def score(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.most * float(np.abs(query).max(initial=0)) * max(1, len(query)) < 1 << 53:
            return (self.rows[at] @ query.astype(np.float64)).astype(np.int64)
        return (self.wide[at] * query).sum(axis=1)

    def waves(self, query: np.ndarray, above: float, label: int | None, other: int | None, own: int) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """(bound, scores, places) of ever larger groups of cells by falling bound; ``bound`` holds for all cells after the group.
        Only rows of ``label`` or not of ``other``, never ``own``; no cells whose rows all score more than ``above``."""
        q = query.astype(np.float64)[None, :]
        high, low = self.halves.bounds(q, self.radii), self.halves.bounds(q, self.radii, -1)
        group: list[np.ndarray] = []
        held, size = 0, _WAVE
        for bound, i, j in visits(high[0][0], high[1][0]):
            if held >= size:
                yield (bound, *self._scored(query, np.concatenate(group), own))
                group, held, size = [], 0, 2 * size
            if (i, j) not in self.at or low[0][0, i] + low[1][0, j] > above:
                continue
            start, end = self.at[i, j]
            if label is not None:
                start, end = (start + int(x) for x in np.searchsorted(self.labels[start:end], (label, label + 1)))
                places = np.arange(start, end)
            else:
                a, b = (start + int(x) for x in np.searchsorted(self.labels[start:end], (other, other + 1)))
                places = np.concatenate([np.arange(start, a), np.arange(b, end)])
            if len(places):
                group.append(places)
                held += len(places)
        if group:
            yield (-np.inf, *self._scored(query, np.concatenate(group), own))

    def _scored(self, query: np.ndarray, places: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        places = places[self.ids[places] != own]
        return self.score(query, places), places

    def _first(self, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(scores) > 4 * k + 64:  # the k-th largest and its ties are enough
            some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, ids = scores[some], ids[some]
        best = np.lexsort((ids, -scores))[:k]
        return scores[best], ids[best]

    def positives(self, own: int, label: int, query: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the first ``k`` other rows of ``label``; rows below ``least`` may be missing."""
        scores, ids, need = np.empty(0, np.int64), np.empty(0, np.int64), least
        for bound, got, places in self.waves(query, np.inf, label, None, own):
            scores, ids = self._first(np.concatenate([scores, got]), np.concatenate([ids, self.ids[places]]), k)
            need = max(need, int(scores[-1])) if len(scores) == k else need
            if bound < need:
                break
        return scores, ids

    def negatives(self, own: int, label: int, query: np.ndarray, windows: list[tuple[int, int]], least: list[int], k: int):
        """For each window (lowest, highest score) the scores and ids of its first ``k`` rows of other labels; rows below
        ``least`` may be missing."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]
        need = [max(low, known) for (low, _), known in zip(windows, least)]
        open_ = [w for w, (low, high) in enumerate(windows) if low <= high]
        if not open_:
            return found
        for bound, got, places in self.waves(query, max(windows[w][1] for w in open_), None, label, own):
            for w in open_:
                inside = (got <= windows[w][1]) & (got >= need[w])
                if inside.any():
                    s, i = found[w]
                    found[w] = self._first(np.concatenate([s, got[inside]]), np.concatenate([i, self.ids[places[inside]]]), k)
                    need[w] = max(need[w], int(found[w][0][-1])) if len(found[w][0]) == k else need[w]
            open_ = [w for w in open_ if bound >= need[w]]
            if not open_:
                break
        return found


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The whole numbers n with low * score <= 100 * n <= high * score, first and last."""
    return -((-low * score) // 100), (high * score) // 100


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.empty((0, 0), np.int64)


def _lists(values: list) -> pa.Array:
    return pa.array([[int(x) for x in v] for v in values], pa.list_(pa.int64()))


class Parts:
    """Which part holds which cells: numbered first part and number of parts of each cell, from the rows in each."""

    def __init__(self, cells: list[tuple[int, int, int]]) -> None:
        self.cells = np.array([c[:2] for c in cells], np.int64).reshape(-1, 2)
        self.first, self.count, held, now = [], [], 0, 0
        for _, _, n in cells:
            alone = n > PART_ROWS
            if held and (alone or held + n > PART_ROWS):
                now, held = now + 1, 0
            self.first.append(now)
            self.count.append(-(-n // PART_ROWS))
            held += n
            if alone:
                now, held = now + self.count[-1], 0
        self.of = {(int(i), int(j)): (f, c) for (i, j), f, c in zip(self.cells, self.first, self.count)}
        starts = np.flatnonzero(np.diff(np.array(self.first), prepend=-1))
        self.starts, self.group_first = starts, np.array(self.first)[starts]
        self.group_count = np.array(self.count)[starts]

    def best(self, bounds: list[np.ndarray]) -> np.ndarray:
        """Per query and group of cells that share their parts: the largest bound of a cell."""
        return np.maximum.reduceat(bounds[0][:, self.cells[:, 0]] + bounds[1][:, self.cells[:, 1]], self.starts, axis=1)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Ids spread, so that those in use (multiples, ranges) fall evenly into parts."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(32))) & np.uint64((1 << 62) - 1)


class Index:
    """The cells of all rows of one dimension, in parts, in the shared folder."""

    def __init__(self, good: DataFrame, k: int, negatives: int) -> None:
        self.k, self.negatives = k, negatives
        total = good.count()
        codes = int(min(MOST_CODES, max(2, (total / CELL_ROWS) ** 0.5)))
        some = good.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, 64 * codes)).select("v").toArrow()
        self.halves = halves = Halves(_matrix(some.column(0).combine_chunks()).astype(np.float64).reshape(len(some), -1), codes)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    rows = _matrix(batch.column("v")).astype(np.float64).reshape(batch.num_rows, -1)
                    found = halves.codes(rows)
                    columns = [*batch.columns, *map(pa.array, (*found, *halves.spread(rows, found)))]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "label", "v", "i", "j", "far_i", "far_j"])

        shape = "id long, label int, v array<long>, i long, j long, far_i double, far_j double"
        placed_rows = stage(good.select("id", "label", "v").mapInArrow(placed, shape), "cells")
        cells = sorted(tuple(r) for r in placed_rows.groupBy("i", "j").agg(F.count("*"), F.max("far_i"), F.max("far_j")).collect())
        self.parts = parts = Parts([c[:3] for c in cells])
        self.radii = [np.full(len(b), -1.0) for b in halves.books]
        for i, j, _, far_i, far_j in cells:
            self.radii[0][i], self.radii[1][j] = max(self.radii[0][i], far_i), max(self.radii[1][j], far_j)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    ids = batch.column("id").to_numpy()
                    found = [parts.of[c] for c in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist())]
                    first, count = np.array(found, np.int64).T
                    part = first + (_mixed(ids) % count.astype(np.uint64)).astype(np.int64)
                    empty = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
                    own = [pa.array(part), pa.array(np.zeros(len(ids), np.int32)), *(batch.column(c) for c in ("id", "label", "v"))]
                    yield pa.RecordBatch.from_arrays([*own, empty, empty, empty], _names())

        self.rows = stage(placed_rows.select("id", "label", "v", "i", "j").mapInArrow(dealt, _SHAPE), "parts")

    def _met(self, queries: DataFrame) -> DataFrame:
        return self.rows.union(queries).repartition("part").sortWithinPartitions("part", "kind", "id")

    def _routed(self, choose: Callable) -> Callable:
        """Queries (``id``, ``label``, ``v``, ``wanted``, ``scores``, ``least``) sent to the parts that ``choose`` names."""
        halves, parts, radii = self.halves, self.parts, self.radii

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 64):
                    batch = whole.slice(at, 64)
                    rows = _matrix(batch.column("v")).astype(np.float64).reshape(batch.num_rows, -1)
                    best = parts.best(halves.bounds(rows, radii))
                    home = best.argmax(axis=1)
                    ids = batch.column("id").to_numpy()
                    row, to = [], []
                    for n, group in choose(batch, best, home):
                        first, count = int(parts.group_first[group]), int(parts.group_count[group])
                        own = first + int(_mixed(ids[n : n + 1])[0]) % count
                        for part in range(first, first + count):
                            if choose.at_home == (group == home[n] and part == own):
                                row.append(n)
                                to.append(part)
                    sent = batch.take(pa.array(row, pa.int64()))
                    kind = pa.array(np.ones(len(row), np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), kind, *sent.columns], _names())

        return run

    def positives(self, anchors: DataFrame) -> DataFrame:
        """``id``, ``other``, ``score``: of each anchor (``id``, ``label``, ``v``) the first ``k`` other rows of its label, and some more."""
        k = self.k
        none = [F.lit(None).cast("array<long>").alias(c) for c in ("wanted", "scores", "least")]
        asked = anchors.select("id", "label", "v", *none)
        home = stage(self._search(asked, _at_home(), "positives"), "positives-home")
        seen = home.groupBy("id").agg(F.sort_array(F.collect_list("score"), False).alias("found"))  # at most k of one part
        least = F.when(F.size("found") >= k, F.array(F.element_at("found", k)))
        again = anchors.join(seen, "id", "left").select("id", "label", "v", *none[:2], least.alias("least"))
        return home.union(self._search(again, _elsewhere(False), "positives")).select("id", F.col("other"), "score")

    def negatives_of(self, asked: DataFrame) -> DataFrame:
        """``id``, ``positive``, ``positive_score``, ``other``, ``score``: of each anchor (``id``, ``label``, ``v``, ``wanted``, ``scores``) and
        positive the first rows of its window, and some more."""
        k = self.negatives
        home = stage(self._search(asked.withColumn("least", F.lit(None).cast("array<long>")), _at_home(), "negatives"), "negatives-home")
        seen = home.groupBy("id", "positive").agg(F.sort_array(F.collect_list("score"), False).alias("found"))  # at most k of one part
        last = F.when(F.size("found") >= k, F.element_at("found", k))
        seen = seen.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("positive", last))).alias("known"))  # one a positive
        known = F.transform("wanted", lambda p: F.coalesce(F.try_element_at("known", p), F.lit(_NONE)))
        again = asked.join(seen, "id", "left").select("id", "label", "v", "wanted", "scores", known.alias("least"))
        return home.union(self._search(again, _elsewhere(True), "negatives"))

    def _search(self, asked: DataFrame, choose: Callable, what: str) -> DataFrame:
        halves, k, negatives = self.halves, self.k, self.negatives

        def answers(cells: Cells, batch: pa.RecordBatch) -> Iterator[tuple]:
            queries = _matrix(batch.column("v")).reshape(batch.num_rows, -1)
            columns = (batch.column(c).to_pylist() for c in ("id", "label", "wanted", "scores", "least"))
            for q, own, label, wanted, scores, least in zip(queries, *columns):
                if what == "positives":
                    s, ids = cells.positives(own, label, q, least[0] if least else _NONE, k)
                    yield from ((own, None, None, int(i), int(x)) for x, i in zip(s, ids))
                    continue
                found = cells.negatives(own, label, q, [window(p) for p in scores], least or [_NONE] * len(scores), negatives)
                for p, score, (s, ids) in zip(wanted, scores, found):
                    yield from ((own, p, score, int(i), int(x)) for x, i in zip(s, ids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, cells = None, [], None
            for batch in batches:
                part, kind = (batch.column(c).to_numpy() for c in ("part", "kind"))
                starts = np.flatnonzero(np.concatenate(([True], (np.diff(part) != 0) | (np.diff(kind) != 0), [True]))) if batch.num_rows else [0]
                for s, e in zip(starts[:-1], starts[1:]):
                    some = batch.slice(int(s), int(e - s))
                    if part[s] != now:
                        now, held, cells = part[s], [], None
                    if kind[s] == 0:
                        held.append((some.column("id").to_numpy(), some.column("label").to_numpy(), _matrix(some.column("v")).reshape(len(some), -1)))
                        continue
                    if cells is None and held:
                        cells, held = Cells(halves, *(np.concatenate(x) for x in zip(*held))), []
                    if cells:
                        rows = list(answers(cells, some))
                        types = [pa.int64()] * 5
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], _FOUND)

        sent = asked.mapInArrow(self._routed(choose), _SHAPE)
        return self._met(sent).mapInArrow(run, ", ".join(f"{c} long" for c in _FOUND))


_FOUND = ["id", "positive", "positive_score", "other", "score"]


def _names() -> list[str]:
    return [c.split()[0] for c in _SHAPE.split(", ")]


class _at_home:
    """Each query goes to one part of the cells with its best bound."""

    at_home = True

    def __call__(self, batch: pa.RecordBatch, best: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, int]]:
        return enumerate(home.tolist())


class _elsewhere:
    """Each query goes to all parts but its home whose bound reaches what it still needs."""

    at_home = False

    def __init__(self, windows: bool) -> None:
        self.windows = windows

    def __call__(self, batch: pa.RecordBatch, best: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, int]]:
        scores, least = (batch.column(c).to_pylist() for c in ("scores", "least"))
        for n in range(batch.num_rows):
            need = least[n][0] if least[n] and not self.windows else -np.inf
            if self.windows:
                needs = [max(low, known) for (low, high), known in zip(map(window, scores[n]), least[n]) if low <= high]
                need = min(needs, default=np.inf)
            yield from ((n, int(g)) for g in np.flatnonzero(best[n] >= need))


def hard_negatives(
    rows: DataFrame, is_anchor: Callable[[Column], Column], label: Column, vec_id: str = "vec_id", vector: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Anchors are the usable rows (see ``usable``) whose id ``is_anchor`` accepts. Scores are whole inner products of the vectors
    times ``SCALE``, rounded down. Higher scores come first, ties by the smaller id. An anchor meets only vectors of its
    own dimension. Anchors without positives, and positives whose window is empty, give no rows; so do empty tables.
    """
    good = stage(usable(rows, vec_id, vector, label), "vectors")
    kinds = sorted(r[0] for r in good.select("dims").distinct().collect())
    found = [_mined(good.filter(F.col("dims") == d), is_anchor, positives, negatives) for d in kinds]
    if not found:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.union, found)


def _mined(good: DataFrame, is_anchor: Callable[[Column], Column], positives: int, negatives: int) -> DataFrame:
    index = Index(good, positives, negatives)
    anchors = good.filter(is_anchor(F.col("id"))).select("id", "label", "v")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    near = index.positives(anchors).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    listed = F.sort_array(F.collect_list(F.struct("place", "other", "score")))  # at most as many as positives
    wanted = stage(near.groupBy("id").agg(listed.alias("near")), "wanted")
    asked = anchors.join(wanted, "id").select("id", "label", "v", F.col("near.other").alias("wanted"), F.col("near.score").alias("scores"))
    order = Window.partitionBy("id", "positive").orderBy(F.desc("score"), "other")
    best = index.negatives_of(asked).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return best.select(
        F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("other").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
