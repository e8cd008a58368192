"""Approximate nearest neighbours: stable projections, kd-trees, and a chi-square stopping test.

Nearness is the inner product. With one more coordinate, sqrt(M^2 - |x|^2) for rows and 0 for queries (M the largest
norm), the largest inner product is the smallest distance: d^2 = |q|^2 + M^2 - 2 q.x. A Gaussian projection to
``DIMENSIONS`` coordinates is 2-stable: the squared projected distance of a row at distance d is d^2 times a chi-square
variable. So rows are visited in order of their projected distance and verified on the original vectors, until the next
projected distance is so large that a row as near as the k-th found would have it with a probability below 1 - ``P``.

On Spark: a kd-tree over the projections of a bounded sample cuts the space into cells; cells are cut by a hash into
parts of about ``PART_ROWS`` rows, so that neither a cell nor a vector that very many rows share is one task. Every part
gets a kd-tree of its own. A query first searches its home part; the distance found decides which other cells its ball
reaches, and it goes to those parts. Vectors and queries meet by a shuffle on the part, where the vectors come first and
queries stream past the tree, so a task holds one part and one batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyward.sources.staging import stage

DIMENSIONS = 8
P = 0.97
SEED = 2024
PART_ROWS = 16384
MOST_CELLS = 4096
SAMPLE = 65536
LEAF = 256
SLACK = 44


def chi_square_quantile(p: float, dims: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees, by bisection of its closed form."""

    def cdf(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def kd_boxes(points: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """``rows`` cut at medians of their widest coordinate until no part has more than ``most``."""
    todo, done = [rows], []
    while todo:
        part = todo.pop()
        if len(part) <= most:
            done.append(part)
            continue
        axis = np.ptp(points[part], axis=0).argmax()
        order = part[np.argsort(points[part, axis], kind="stable")]
        todo += [order[len(order) // 2 :], order[: len(order) // 2]]
    return done


class Splits:
    """Top kd-tree: numbered cells from medians of a sample."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.tree: list[tuple[int, float, int, int]] = []
        self.cells = 0
        self._cut(sample, max(1, cells))

    def _cut(self, points: np.ndarray, cells: int) -> int:
        """Number of the node made; leaves are -1 - cell."""
        if cells < 2 or len(points) < 2:
            self.cells += 1
            return -self.cells
        axis = int(np.ptp(points, axis=0).argmax())
        value = float(np.median(points[:, axis]))
        below = points[:, axis] < value
        node = len(self.tree)
        self.tree.append((axis, value, 0, 0))
        left = self._cut(points[below], cells // 2)
        self.tree[node] = (axis, value, left, self._cut(points[~below], cells - cells // 2))
        return node

    def assign(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(0 if self.tree else -1, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            axis, value, left, right = self.tree[node]
            below = points[rows, axis] < value
            todo += [(left, rows[below]), (right, rows[~below])]
        return out


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        p = points[:, axis, None]
        out += np.maximum(np.maximum(low[None, :, axis] - p, p - high[None, :, axis]), 0) ** 2
    return out


def inner(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of aligned rows, added from left to right in double precision."""
    return np.cumsum(queries * rows, axis=1)[:, -1]


class Part:
    """The vectors of a part in the order of the leaves of a kd-tree on their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray) -> None:
        leaves = kd_boxes(projected, np.arange(len(ids)), LEAF)
        order = np.concatenate(leaves)
        self.ids, self.vectors = ids[order], vectors[order]
        self.ends = np.cumsum([len(r) for r in leaves])
        self.low = np.array([projected[r].min(axis=0) for r in leaves])
        self.high = np.array([projected[r].max(axis=0) for r in leaves])

    def search(self, ids, queries, projected, bound, base, k: int, stop: float) -> list[tuple]:
        """Per query its id, the ids and scores of its best, and the k-th squared distance known then. ``base`` is
        |q|^2 + M^2, ``bound`` the k-th squared distance known before."""
        keep, n = k + SLACK, len(ids)
        scores, at = np.full((n, keep), -np.inf), np.full((n, keep), -1)
        near = box_distance(projected, self.low, self.high)
        order = np.argsort(near, axis=1, kind="stable")
        kth, active = bound.copy(), np.arange(n)
        for turn in range(len(self.ends)):
            leaf = order[active, turn]
            going = near[active, leaf] <= kth[active] * stop
            active, leaf = active[going], leaf[going]
            if not len(active):
                break
            by = np.argsort(leaf, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                end = self.ends[leaf[group[0]]]
                start = self.ends[leaf[group[0]] - 1] if leaf[group[0]] else 0
                q = active[group]
                got = queries[q] @ self.vectors[start:end].T
                got[self.ids[None, start:end] == ids[q, None]] = -np.inf
                # Products may differ in the last bits from those summed in order, so near ties stay until then.
                better = got.max(axis=1) >= scores[q, -1] - 1e-9 * (1 + np.abs(np.nan_to_num(scores[q, -1], neginf=0)))
                q, got = q[better], got[better]
                all_s = np.concatenate([scores[q], got], axis=1)
                all_at = np.concatenate([at[q], np.broadcast_to(np.arange(start, end), got.shape)], axis=1)
                best = np.lexsort((self.ids[all_at], -all_s), axis=1)[:, :keep]
                scores[q], at[q] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_at, best, 1)
                kth[q] = np.minimum(kth[q], base[q] - 2 * scores[q, k - 1])
        out = []
        for i in range(n):
            real = at[i, scores[i] > -np.inf]
            exact = inner(np.broadcast_to(queries[i], (len(real), queries.shape[1])), self.vectors[real])
            best = np.lexsort((self.ids[real], -exact))[:k]
            out.append((ids[i], self.ids[real][best], exact[best], kth[i]))
        return out


def _search(matrix: np.ndarray, most: float, k: int, stop: float):
    """Arrow batches sorted by part with vectors first: each query's best of the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, part = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, number, kind, ids, bound = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            vectors = np.stack(batch.column(5).to_numpy(zero_copy_only=False)).astype(np.float64)
            starts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            for rows in np.split(np.arange(batch.num_rows), starts):
                at = (cell[rows[0]], number[rows[0]])
                if at != key:
                    key, held, part = at, [], None
                if kind[rows[0]] == 0:
                    held.append((ids[rows], vectors[rows]))
                    continue
                if part is None and held:
                    own = np.concatenate([v for _, v in held])
                    part = Part(np.concatenate([i for i, _ in held]), own, own @ matrix[:-1] + _extra(own, most) * matrix[-1])
                    held = []
                if part is None:
                    continue
                q = vectors[rows]
                base = (q * q).sum(axis=1) + most
                results = part.search(ids[rows], q, q @ matrix[:-1], bound[rows], base, k, stop)
                sizes = [len(v) for _, v, _, _ in results]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([r[0] for r in results], sizes), pa.int64()),
                        pa.array(np.concatenate([r[1] for r in results]), pa.int64()),
                        pa.array(np.concatenate([r[2] for r in results]), pa.float64()),
                        pa.array(np.repeat([r[3] for r in results], sizes), pa.float64()),
                    ],
                    ["query_id", "vec_id", "score", "kth"],
                )

    return run


def _extra(vectors: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(most - (vectors * vectors).sum(axis=1), 0))[:, None]


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null, empty or zero and has finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0))


def nearest(rows: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", p: float = P) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` largest inner products found for each query row.

    ``is_query`` is a condition on the id. Null ids take no part. Vectors meet only vectors of their own dimension. Ties
    go to the smaller id; a query's own row is no candidate. Of rows that share an id the one with the smallest vector counts.
    Of ids with the same vector the ``k`` + 1 smallest are candidates, which loses nothing: no result can name another. Empty tables give an empty result.
    """
    named = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    good = usable(named.filter("id IS NOT NULL"), "v").groupBy("id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v"))
    good = stage(good, "vectors")
    kinds = [r[0] for r in good.select("dims").distinct().collect()]
    if not kinds:
        return good.selectExpr("id AS query_id", "0 AS rank", "id AS vec_id", "0D AS score").limit(0)
    found = [_nearest(good.filter(F.col("dims") == d).select("id", "v"), d, is_query, k, p) for d in sorted(kinds)]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _nearest(good: DataFrame, dims: int, is_query, k: int, p: float) -> DataFrame:
    same = Window.partitionBy("v").orderBy("id")
    chosen = good.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).drop("n")
    matrix = np.random.default_rng(SEED).standard_normal((dims + 1, DIMENSIONS))
    stop = chi_square_quantile(p, DIMENSIONS)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    most = good.agg(F.max(square)).first()[0] * (1 + 1e-12)
    total = good.count()
    cells = min(MOST_CELLS, -(-total // PART_ROWS))
    some = good.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, 64 * cells)).select("v").toArrow()
    own = np.stack(some.column(0).to_numpy()).astype(np.float64)
    splits = Splits(own @ matrix[:-1] + _extra(own, most) * matrix[-1], cells)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                points = own @ matrix[:-1] + _extra(own, most) * matrix[-1]
                cell = pa.array(splits.assign(points))
                yield pa.RecordBatch.from_arrays([*batch.columns, cell, pa.array(list(points))], ["id", "v", "cell", "point"])

    in_cells = stage(chosen.mapInArrow(placed, "id long, v array<double>, cell long, point array<double>"), "cells")
    sides = [f(F.col("point")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(DIMENSIONS)]
    boxes = sorted(in_cells.groupBy("cell").agg(F.count("*").alias("rows"), *sides).collect())
    numbers = [b["cell"] for b in boxes]
    low, high = (np.array([[b[f"{n}{i}"] for i in range(DIMENSIONS)] for b in boxes]) for n in ("low", "high"))
    parts = [-(-b["rows"] // PART_ROWS) for b in boxes]
    count = {int(c): n for c, n in zip(numbers, parts)}

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                near = box_distance(own @ matrix[:-1], low, high).argmin(axis=1)
                ids = batch.column(0).to_numpy()
                cell = np.array(numbers, np.int64)[near]
                yield _routed(cell, ids % np.array(parts, np.int64)[near], ids, np.full(len(ids), np.inf), batch.column(1))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, kth = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            own = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
            near = box_distance(own @ matrix[:-1], low, high)
            was = near.argmin(axis=1)
            for i, n in zip(*np.nonzero(near <= kth[:, None] * stop)):
                to = np.array([m for m in range(parts[n]) if n != was[i] or m != ids[i] % parts[n]], np.int64)
                if len(to):
                    rows = batch.column(1).slice(int(i), 1).take(pa.array(np.zeros(len(to), np.int64)))
                    yield _routed(np.full(len(to), numbers[n]), to, np.full(len(to), ids[i]), np.full(len(to), kth[i]), rows)

    shape = "cell long, part long, kind int, id long, bound double, v array<double>"
    own_part = F.pmod(F.col("id"), F.element_at(F.create_map(*(F.lit(x) for c in count.items() for x in c)), F.col("cell")))
    vectors = in_cells.select("cell", own_part.alias("part"), F.lit(0).alias("kind"), "id", F.lit(0.0).alias("bound"), "v")

    def searched(queries: DataFrame) -> DataFrame:
        met = vectors.union(queries).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind", "id")
        return met.mapInArrow(_search(matrix, most, k, stop), "query_id long, vec_id long, score double, kth double")

    queries = good.filter(is_query(F.col("id")))
    first = stage(searched(queries.mapInArrow(home, shape)), "home")
    reached = first.groupBy("query_id").agg(F.min("kth").alias("kth"))
    again = queries.join(reached, queries["id"] == reached["query_id"], "left")
    again = again.select("id", "v", F.coalesce("kth", F.lit(float("inf"))).alias("kth"))
    return first.union(searched(again.mapInArrow(reach, shape))).drop("kth")


def _routed(cell, part, ids, bound, vectors) -> pa.RecordBatch:
    kind = np.ones(len(ids), np.int32)
    return pa.RecordBatch.from_arrays([*map(pa.array, (cell, part, kind, ids, bound)), vectors], ["cell", "part", "kind", "id", "bound", "v"])
