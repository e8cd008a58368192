"""K-means with restarts, cluster quality, principal components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyward.functions.numbers import ratio
from tallyward.sources.staging import stage

STILL = 1e-9
TASK_ROWS = 2_000


def with_vector(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)


@dataclass(frozen=True)
class BestFit:
    """The cheapest of several restarts for one number of clusters; ``steps`` until no centre moved."""

    k: int
    cost: float
    centres: np.ndarray
    steps: int


def _over_rows(df: DataFrame, work: Callable[[np.ndarray], Iterator[tuple]], join: Callable, width: int) -> DataFrame:
    """``work`` gives (key, values) pairs for a block of rows; values of one key are joined by ``join``.

    Blocks are joined inside a task first, so a task hands on one row a key, and one more grouped step joins the tasks.
    """
    names = [f"v{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if batch.num_rows:
                for key, values in work(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)):
                    held[key] = join(held[key], values) if key in held else values
        rows = [(*key, *values) for key, values in held.items()]
        data = np.array(rows, np.float64).reshape(-1, 2 + width)
        yield pa.RecordBatch.from_arrays([pa.array(data[:, i]) for i in range(2 + width)], ["run", "part", *names])

    shape = ", ".join(f"{c} double" for c in ("run", "part", *names))
    return df.mapInArrow(run, shape)


def _draw(rows: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) for each row, from its values and the seed alone, however the rows are spread."""
    bits = np.ascontiguousarray(rows).view(np.uint64)
    state = np.full(len(rows), np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    for column in bits.T:
        state = (state ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        state ^= state >> np.uint64(29)
    state = (state ^ (state >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return ((state >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, a row for each centre; column by column, as whole rows of numbers are fast and short sums are not."""
    out = np.zeros((len(centres), len(rows)))
    for x, c in zip(np.ascontiguousarray(rows.T), centres.T):
        gap = x[None] - c[:, None]
        gap *= gap
        out += gap
    return out


def first_centres(vectors: DataFrame, ks: Sequence[int], seeds: Sequence[int]) -> dict[tuple[int, int], np.ndarray]:
    """Starting centres of every (k, seed): each next row is drawn with its squared distance to those drawn before as weight.

    Drawing is a race: the row with the smallest -log(u) / weight wins, which one pass finds for all seeds. The rows drawn
    for the largest k serve the smaller ones too.
    """
    width = len(vectors.columns)
    chosen: dict[int, np.ndarray] = {}
    for turn in range(max(ks)):
        def race(rows: np.ndarray) -> Iterator[tuple]:
            for i, seed in enumerate(seeds):
                weight = _squared(rows, chosen[i]).min(axis=0) if turn else np.ones(len(rows))
                with np.errstate(divide="ignore"):
                    time = -np.log(_draw(rows, seed + 1000003 * turn)) / weight
                best = int(time.argmin())
                yield (i, 0), (time[best], *rows[best])

        found = _over_rows(vectors, race, min, width + 1)
        best = F.min(F.struct(*[f"v{i}" for i in range(width + 1)])).alias("best")
        for r in found.groupBy("run").agg(best).collect():
            row = np.array(r.best[1:])[None]
            i = int(r.run)
            chosen[i] = row if turn == 0 else np.concatenate([chosen[i], row])
    return {(k, i): chosen[i][:k] for k in ks for i in range(len(seeds)) if i in chosen}


def settle(vectors: DataFrame, starts: dict, weight: str | None = None) -> dict:
    """Lloyd steps for many sets of centres at once, each until none of its centres moves: (centres, cost, steps).

    A row counts as many times as its ``weight`` says. A step is one pass over the rows for all runs that still move. Rows meet centres of bounded number (runs x k) in
    arrays; what comes back is a row for each run and cluster. An empty cluster keeps its centre. A step never raises the
    cost and there are finitely many partitions, so every run ends.
    """
    columns = [c for c in vectors.columns if c != weight]
    weighted = vectors.select(*columns, F.lit(1.0).alias("_weight") if weight is None else F.col(weight))
    width, names = len(columns), list(starts)
    moving, done = {i: np.asarray(starts[n], float) for i, n in enumerate(names)}, {}
    steps = 0
    while moving:
        steps += 1
        now = dict(moving)

        def sums(block: np.ndarray) -> Iterator[tuple]:
            rows, times = block[:, :-1], block[:, -1:]
            weighed = np.concatenate((times, times, rows * times), axis=1)
            for i, centres in now.items():
                d = _squared(rows, centres)
                near = d.argmin(axis=0)
                values = weighed.copy()
                values[:, 1] *= d[near, np.arange(len(rows))]
                own = near[None] == np.arange(len(centres))[:, None]
                total = own.astype(np.float64) @ values
                for c in np.flatnonzero(own.any(axis=1)):
                    yield (i, int(c)), total[c]

        total = [F.sum(f"v{i}").alias(f"v{i}") for i in range(width + 2)]
        after, cost = {i: c.copy() for i, c in now.items()}, dict.fromkeys(now, 0.0)
        for r in _over_rows(weighted, sums, np.add, width + 2).groupBy("run", "part").agg(*total).collect():
            after[int(r.run)][int(r.part)] = np.array(r[4:]) / r[2]
            cost[int(r.run)] += r[3]
        for i, centres in after.items():
            if np.all(np.abs(centres - now[i]) <= STILL * (1 + np.abs(centres))):
                done[i] = (centres, cost[i], steps)
                del moving[i]
            else:
                moving[i] = centres
    return {names[i]: d for i, d in done.items()}


def fit_restarts(
    df: DataFrame, columns: Sequence[str], ks: Sequence[int], restarts: int = 20, seed: int = 1612
) -> dict[int, BestFit]:
    """K-means for every k with several seeds; the lowest cost wins, the first of equals.

    All runs move together: a step is one job however many runs there are. Equal rows are one row with their number as weight.
    A step reads few bytes for much work, and by its size Spark would give it to one task; so each ``TASK_ROWS`` rows
    are a file, up to one for each core.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    vectors = stage(rows.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("_weight")), "vectors")
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() // TASK_ROWS))
    if tasks > 1:
        vectors = stage(vectors.repartition(tasks, *columns), "dealt-vectors")
    fits = settle(vectors, first_centres(vectors.drop("_weight"), ks, [seed + i for i in range(restarts)]), "_weight")
    best = {}
    for (k, i), (centres, cost, steps) in sorted(fits.items()):
        if k not in best or cost < best[k].cost:
            best[k] = BestFit(k, cost, centres, steps)
    return best


def assign(df: DataFrame, columns: Sequence[str], centres: np.ndarray) -> DataFrame:
    """Rows with the number of their nearest centre, the smaller of equals; the key column travels along."""
    def squared(centre):
        return sum(((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, centre)), F.lit(0.0))

    near = F.array_min(F.array(*[F.struct(squared(c).alias("d"), F.lit(i).alias("id")) for i, c in enumerate(centres)]))
    return df.withColumn("cluster", near["id"])


def save_centres(spark: SparkSession, columns: Sequence[str], centres: np.ndarray, path: str) -> None:
    rows = [(i, *map(float, c)) for i, c in enumerate(centres)]
    shape = "cluster int, " + ", ".join(f"`{c}` double" for c in columns)
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("errorifexists").parquet(path)


def load_centres(spark: SparkSession, columns: Sequence[str], path: str) -> np.ndarray:
    return np.array([[r[c] for c in columns] for r in spark.read.parquet(path).orderBy("cluster").collect()])


def lloyd_step(df: DataFrame, columns: Sequence[str], centres: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One k-means step from given centres: nearest centre per row, then the new means with sizes and cost.

    The centres, one row per cluster, travel as one array value. Equal distances go to the first cluster.
    """
    listed = centres.agg(
        F.sort_array(F.collect_list(F.struct(F.col(cluster).alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("at"))))
    ).scalar()
    point = F.array(*[F.col(c).cast("double") for c in columns])

    def squared(at):
        return F.aggregate(F.zip_with(at, F.col("_point"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)

    near = F.array_min(F.transform("_listed", lambda c: F.struct(squared(c["at"]).alias("d"), c["id"].alias("id"))))
    placed = df.select(*columns, point.alias("_point"), listed.alias("_listed")).select(*columns, near.alias("_near"))
    return placed.groupBy(F.col("_near.id").alias(cluster)).agg(
        F.count(F.lit(1)).alias("size"), F.sum("_near.d").alias("cost"), *[F.avg(c).alias(c) for c in columns]
    )


def calinski_harabasz(labelled: DataFrame, columns: Sequence[str], cluster: str, over: Sequence[str] = ()) -> DataFrame:
    """(B/(k-1)) / (W/(n-k)) from one grouped pass; ``over`` scores several labelings at once."""
    sums = [F.sum(F.col(c).cast("double")).alias(f"_s_{c}") for c in columns]
    squares = sum((F.col(c).cast("double") * F.col(c) for c in columns), F.lit(0.0))
    per_cluster = labelled.groupBy(*over, cluster).agg(F.count(F.lit(1)).alias("_n"), F.sum(squares).alias("_q"), *sums)
    norm = sum((F.col(f"_s_{c}") * F.col(f"_s_{c}") for c in columns), F.lit(0.0))
    grand = sum((F.pow(F.sum(f"_s_{c}"), 2) for c in columns), F.lit(0.0))
    parts = per_cluster.groupBy(*over).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("_n").alias("n"),
        F.sum(F.col("_q") - norm / F.col("_n")).alias("within"),
        (F.sum(norm / F.col("_n")) - grand / F.sum("_n")).alias("between"),
    )
    score = ratio(ratio(F.col("between"), F.col("k") - 1), ratio(F.col("within"), F.col("n") - F.col("k")))
    return parts.withColumn("ch", score)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairwise correlations in one pass, long form."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("corr")) for a, b in pairs]
    mirror = [F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"{a}|{b}").alias("corr")) for a, b in pairs if a != b]
    return row.select(F.inline(F.array(*entries, *mirror)))


@dataclass(frozen=True)
class Components:
    """Scaled principal components: variance shares and scores by key."""

    variance: DataFrame
    scores: DataFrame


def principal_components(df: DataFrame, key: str, columns: Sequence[str]) -> Components:
    """PCA of the standardised columns. Each component points where its largest loading is positive.

    The columns are read for the scaling, for the covariances and for the scores, so they are staged first.
    """
    vectors = with_vector(stage(df.select(key, *columns), "components"), columns, "_raw")
    scaled = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True).fit(vectors).transform(vectors)
    model = PCA(k=len(columns), inputCol="_scaled", outputCol="_pc").fit(scaled)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(len(columns))]
    shares = [float(v) for v in model.explainedVariance.toArray()]
    spark = df.sparkSession
    variance = spark.createDataFrame(list(enumerate(shares, start=1)), "component int, variance_share double")
    pc = vector_to_array(F.col("_pc"))
    scores = model.transform(scaled).select(key, *[(pc[j] * signs[j]).alias(f"pc{j + 1}") for j in range(len(columns))])
    return Components(variance, scores)
