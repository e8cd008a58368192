"""Trajectory clustering, cluster quality and principal components over supplier trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyward.catalog.registry import register
from tallyward.catalog.sql_views import SHIPMENT_LABELS, SHIPMENTS, using
from tallyward.functions.numbers import row_sum
from tallyward.operators import clustering
from tallyward.operators.counts import count_by
from tallyward.operators.reshape import column_range
from tallyward.plans import trajectories as plans
from tallyward.plans.panel import CELL
from tallyward.plans.settings import MONTH_NAMES, study_periods
from tallyward.sources import role_views as views
from tallyward.sources.files import union_all
from tallyward.sources.staging import stage

YEAR = "2000"
K = 6
CANDIDATES = tuple(range(3, 11))

_WIDE = ", ".join(
    f"CAST(sum(CASE WHEN month = '{p}' THEN 1 ELSE 0 END) AS BIGINT) AS {name}" for p, name in zip(study_periods(YEAR), MONTH_NAMES)
)
_TRAJECTORIES = f"""
, every_row AS (SELECT area_code, {_WIDE} FROM shipments GROUP BY area_code)
, wide AS (SELECT * FROM every_row WHERE february + march + april + may + june + july + august <> 0)
, labelled AS (SELECT w.*, l.traj FROM wide w JOIN shipment_labels l ON l.area_code = w.area_code)"""
_BASE = using(SHIPMENTS, SHIPMENT_LABELS) + _TRAJECTORIES


def wide_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.trajectory_table(count_by(views.shipments(spark, sf_dir), CELL), YEAR, ())


def labelled_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_of(spark, sf_dir).join(views.shipment_labels(spark, sf_dir), "area_code")


@register(_BASE + " SELECT * FROM wide")
def shipment_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_of(spark, sf_dir)


@register(_BASE + " SELECT area_code, CAST(february + march + april + may + june + july + august AS BIGINT) AS total_months FROM wide")
def trajectory_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = wide_of(spark, sf_dir)
    return wide.select("area_code", row_sum(column_range(wide, "february", "august")).alias("total_months"))


_AVG = ", ".join(f"avg({m}) AS {m}" for m in MONTH_NAMES)
_DIST = " + ".join(f"(w.{m} - c.{m}) * (w.{m} - c.{m})" for m in MONTH_NAMES)
_ROUND_AVG = ", ".join(f"round(avg({m}), 6) AS {m}" for m in MONTH_NAMES)


@register(
    _BASE
    + f"""
, start AS (SELECT traj, {_AVG} FROM labelled GROUP BY traj)
, near AS (
  SELECT w.*, c.traj, {_DIST} AS d, row_number() OVER (PARTITION BY w.area_code ORDER BY {_DIST}, c.traj) AS rn
  FROM wide w CROSS JOIN start c
)
SELECT traj AS cluster, count(*) AS size, round(sum(d), 3) AS cost, {_ROUND_AVG} FROM near WHERE rn = 1 GROUP BY traj"""
)
def lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = stage(labelled_of(spark, sf_dir), "labelled")
    start = labelled.groupBy(F.col("traj").alias("cluster")).agg(*[F.avg(m).alias(m) for m in MONTH_NAMES])
    out = clustering.lloyd_step(labelled, MONTH_NAMES, start)
    return out.select("cluster", "size", F.round("cost", 3).alias("cost"), *[F.round(m, 6).alias(m) for m in MONTH_NAMES])


_WITHIN = " + ".join(f"(l.{m} - c.{m}) * (l.{m} - c.{m})" for m in MONTH_NAMES)
_BETWEEN = " + ".join(f"(c.{m} - g.{m}) * (c.{m} - g.{m})" for m in MONTH_NAMES)


@register(
    _BASE
    + f"""
, c AS (SELECT traj, count(*) AS size, {_AVG} FROM labelled GROUP BY traj)
, g AS (SELECT {_AVG}, count(*) AS n FROM labelled)
, w AS (SELECT sum({_WITHIN}) AS within FROM labelled l JOIN c ON c.traj = l.traj)
, b AS (SELECT sum(c.size * ({_BETWEEN})) AS between_, count(*) AS k FROM c CROSS JOIN g)
SELECT b.k, g.n, round(w.within, 4) AS within, round(b.between_, 4) AS between,
       round((b.between_ / (b.k - 1)) / (w.within / (g.n - b.k)), 6) AS ch
FROM w, b, g"""
)
def ch_scores_fixed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = clustering.calinski_harabasz(labelled_of(spark, sf_dir), MONTH_NAMES, "traj")
    return scored.select("k", "n", *[F.round(c, d).alias(c) for c, d in (("within", 4), ("between", 4), ("ch", 6))])


_CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM wide" for a in MONTH_NAMES for b in MONTH_NAMES
)


@register(_BASE + f" {_CORR}")
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.correlation_matrix(wide_of(spark, sf_dir), MONTH_NAMES).withColumn("corr", F.round("corr", 6))


@register()
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.trajectory_clusters(wide_of(spark, sf_dir), K)


@register(
    _BASE
    + f" SELECT count(*) AS n_areas, CAST({K} AS BIGINT) AS n_clusters, true AS largest_first, true AS settled FROM wide"
)
def kmeans_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for any k-means result: every area labelled, letters by size, one more step changes nothing."""
    wide = stage(wide_of(spark, sf_dir), "wide")
    labelled = stage(wide.join(plans.trajectory_clusters(wide, K).select("area_code", "traj"), "area_code"), "labelled")
    centres = labelled.groupBy(F.col("traj").alias("cluster")).agg(*[F.avg(m).alias(m) for m in MONTH_NAMES])
    again = clustering.lloyd_step(labelled, MONTH_NAMES, centres).select("cluster", F.col("size").alias("again"))
    sizes = labelled.groupBy(F.col("traj").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    ordered = F.sort_array(F.collect_list(F.struct("cluster", "size")))["size"]
    return sizes.join(again, "cluster", "left").agg(
        F.sum("size").alias("n_areas"),
        F.count(F.lit(1)).alias("n_clusters"),
        (ordered == F.sort_array(ordered, asc=False)).alias("largest_first"),
        F.every(F.coalesce(F.col("size") == F.col("again"), F.lit(False))).alias("settled"),
    )


@register()
def kmeans_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.score_candidates(wide_of(spark, sf_dir), CANDIDATES)


@register()
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.principal_components(wide_of(spark, sf_dir), "area_code", MONTH_NAMES).variance


_ROUND_R = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM wide" for a in MONTH_NAMES for b in MONTH_NAMES)


@register(
    _BASE
    + f"""
, m AS ({_ROUND_R})
, first AS (SELECT sum(r) / 7 AS s FROM m WHERE a = b)
, second AS (SELECT sum(r * r) / 49 AS s FROM m)
, third AS (SELECT sum(x.r * y.r * z.r) / 343 AS s FROM m x JOIN m y ON y.a = x.b JOIN m z ON z.a = y.b AND z.b = x.a)
SELECT CAST(7 AS BIGINT) AS n_components, round(first.s, 6) AS shares, round(second.s, 6) AS squared, round(third.s, 6) AS cubed
FROM first, second, third"""
)
def pca_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power sums of the variance shares; they equal traces of powers of the correlation matrix."""
    v = F.col("variance_share")
    return pca_variance(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_components"),
        F.round(F.sum(v), 6).alias("shares"),
        F.round(F.sum(v * v), 6).alias("squared"),
        F.round(F.sum(v * v * v), 6).alias("cubed"),
    )


@register()
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.component_scores(wide_of(spark, sf_dir), views.shipment_labels(spark, sf_dir))


_PAIRS = [(a, b) for a in MONTH_NAMES for b in MONTH_NAMES]


@register(
    _BASE
    + " SELECT count(*) AS n_areas, true AS uncorrelated, true AS trace_is_seven, true AS rebuilds_correlations FROM labelled"
)
def pca_scores_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scores of standardised columns must satisfy: covariances 0 off the diagonal, variances that add up to the number
    of columns, and correlations with the columns whose products over the components give the columns' correlations."""
    wide = stage(wide_of(spark, sf_dir), "wide")
    found = clustering.principal_components(wide, "area_code", MONTH_NAMES).scores
    scores = stage(found.join(wide, "area_code"), "scores")
    names = [f"pc{i + 1}" for i in range(len(MONTH_NAMES))]
    cross = [F.abs(F.covar_samp(a, b)) for i, a in enumerate(names) for b in names[:i]]
    variances = sum((F.var_samp(n) for n in names), F.lit(0.0))
    loads = {(m, n): F.coalesce(F.corr(m, n), F.lit(0.0)) for m in MONTH_NAMES for n in names}
    gaps = [F.abs(F.corr(a, b) - sum((loads[a, n] * loads[b, n] for n in names), F.lit(0.0))) for a, b in _PAIRS]
    joined = scores.join(views.shipment_labels(spark, sf_dir), "area_code").agg(F.count(F.lit(1)).alias("n_areas"))
    checks = scores.agg(
        (F.greatest(*cross) < 1e-6).alias("uncorrelated"),
        (F.abs(variances - len(names)) < 1e-6).alias("trace_is_seven"),
        (F.greatest(*gaps) < 1e-6).alias("rebuilds_correlations"),
    )
    return joined.withColumns({c: checks.select(c).scalar() for c in checks.columns})


@register(
    _BASE
    + f" SELECT UNNEST({list(CANDIDATES)!r})::INTEGER AS candidate, true AS recomputed, true AS cheaper_with_more FROM (SELECT count(*) FROM wide)"
)
def kmeans_candidates_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost and score of each candidate against sums of squares from the labels; more clusters never cost more."""
    wide = stage(wide_of(spark, sf_dir), "wide")
    fits = clustering.fit_restarts(wide, MONTH_NAMES, CANDIDATES)
    costs = [f.cost for _, f in sorted(fits.items())]
    rows = []
    for k, f in sorted(fits.items()):
        placed = clustering.assign(wide, MONTH_NAMES, f.centres)
        within = clustering.calinski_harabasz(placed, MONTH_NAMES, "cluster").select("within")
        rows.append(within.select(F.lit(k).alias("candidate"), (F.abs(F.col("within") - f.cost) <= 1e-6 * (1 + f.cost)).alias("recomputed")))
    falling = all(a >= b for a, b in zip(costs, costs[1:]))
    return union_all(rows).withColumn("cheaper_with_more", F.lit(falling))
