"""Exact quantiles of real values in groups of any size, by narrowing brackets around the wanted ranks.

A window over the distinct values of a group is one task, which real values make as large as the group. Here a group with more
than ``limit`` rows is never brought together: a mergeable sketch of each task's values proposes a bracket for each wanted rank,
exact counts decide whether the rank lies in it, and only rows inside the brackets go on to the next round, a small
fraction of those before. What the sketch says changes the number of rounds, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyward.operators.counts import exact_quantiles, value_frequencies
from tallyward.sources.staging import fresh_path, remove, stage, stage_at

MOST_ROWS = 1_000_000
ACCURACY = 2_000



def _joined(rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows with the columns of ``other``; NULL keys match each other."""
    renamed = other.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = reduce(lambda x, y: x & y, [rows[k].eqNullSafe(renamed[f"_k{i}"]) for i, k in enumerate(keys)], F.lit(True))
    return rows.join(renamed, same, how).drop(*(f"_k{i}" for i in range(len(keys)))) if how == "inner" else rows.join(renamed, same, how)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float], limit: int = MOST_ROWS, accuracy: int = ACCURACY) -> DataFrame:
    """Per group the quantiles named in ``at``, linear between the two neighbouring ranks; doubles.

    NULL values do not count, groups of them alone have no row; NULL keys are a group; NaN is the largest value. Values meet
    only where they are inside a bracket of at most ``limit`` rows, or in groups that small.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    ends = [F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    sizes = stage(rows.groupBy(*keys).agg(*ends), "group-sizes")
    large = sizes.filter(F.col("_n") > limit)
    if large.isEmpty():
        return exact_quantiles(value_frequencies(rows, keys, "_v"), keys, "_v", at)
    # The groups of more than ``limit`` rows are at most a ``limit``-th of the rows.
    small = value_frequencies(_joined(rows, large.select(*keys), keys, "left_anti"), keys, "_v")
    found = [exact_quantiles(small, keys, "_v", at), _of_large(_joined(rows, large.select(*keys), keys), large, keys, at, limit, accuracy)]
    return found[0].select(*keys, *at).union(found[1].select(*keys, *at))


def _of_large(rows: DataFrame, large: DataFrame, keys: Sequence[str], at: dict[str, float], limit: int, accuracy: int) -> DataFrame:
    spark = rows.sparkSession
    place = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in at.items()}
    ranks = [F.floor(w) + 1 for w in place.values()] + [F.least(F.floor(w) + 2, F.col("_n")) for w in place.values()]
    wanted = large.select(*keys, F.explode(F.array_distinct(F.array(*ranks))).alias("_rank"), "_low", "_high", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_inside"))
    todo, done, inside, held = stage(wanted, "brackets"), [], rows, None
    key = [*keys, "_rank"]
    while True:
        same = F.col("_low").eqNullSafe(F.col("_high"))
        done.append(todo.filter(same).select(*key, F.col("_low").alias("_value")))
        left = todo.filter(~same)
        ready = left.filter(F.col("_inside") <= limit)
        within = F.col("_v").between(F.col("_low"), F.col("_high"))
        if not ready.isEmpty():
            done.append(stage(_at_rank(_joined(inside, ready, keys).filter(within), key), "ranks"))  # before its rows are removed
        left = left.filter(F.col("_inside") > limit)
        if left.isEmpty():
            break
        # Rows inside a bracket once for each of its ranks; brackets of one group may overlap.
        near = _joined(inside, left, keys).filter(within)
        path = fresh_path(spark, "inside")
        near = stage_at(near.select(*key, "_v", "_low", "_high", "_below", "_inside"), path)
        share = (F.col("_rank") - F.col("_below")) / F.col("_inside")
        steps = F.percentile_approx("_v", [i / 64 for i in range(65)], accuracy).alias("_steps")
        cuts = near.groupBy(*key).agg(steps, F.first("_low").alias("_low"), F.first("_high").alias("_high"), F.first("_below").alias("_below"), F.first(share).alias("_share"))
        step = F.floor(F.col("_share") * 64).cast("int")
        low = F.element_at("_steps", F.greatest(step, F.lit(1)))
        high = F.element_at("_steps", F.least(step + 3, F.lit(65)))
        # A proposal that leaves the bracket as it is gives way to one that cuts it at a value inside, or takes its top alone.
        middle, stuck = F.element_at("_steps", 33), (low == F.col("_low")) & (high == F.col("_high"))
        from_ = F.when(stuck & (middle == F.col("_high")), F.col("_high")).otherwise(low)
        to = F.when(stuck & (middle < F.col("_high")), middle).otherwise(high)
        cuts = stage(cuts.select(*key, from_.alias("_from"), to.alias("_to")), "cuts")
        met = _joined(near, cuts, key)
        below, upto = F.count_if(F.col("_v") < F.col("_from")), F.count_if(F.col("_v") <= F.col("_to"))
        firsts = [F.first(c).alias(c) for c in ("_low", "_high", "_below", "_from", "_to")]
        over = F.min(F.when(F.col("_v") > F.col("_to"), F.col("_v"))).alias("_over")
        under = F.max(F.when(F.col("_v") < F.col("_from"), F.col("_v"))).alias("_under")
        counted = met.groupBy(*key).agg(below.alias("_less"), upto.alias("_upto"), F.count("*").alias("_all"), over, under, *firsts)
        rank = F.col("_rank") - F.col("_below")
        too_low, too_high = rank > F.col("_upto"), rank <= F.col("_less")

        def pick(lower: Column, middle: Column, upper: Column) -> Column:
            return F.when(too_high, lower).when(too_low, upper).otherwise(middle)

        todo = stage(
            counted.select(
                *key,
                pick(F.col("_low"), F.col("_from"), F.col("_over")).alias("_low"),
                pick(F.col("_under"), F.col("_to"), F.col("_high")).alias("_high"),
                (F.col("_below") + pick(F.lit(0), F.col("_less"), F.col("_upto"))).alias("_below"),
                pick(F.col("_less"), F.col("_upto") - F.col("_less"), F.col("_all") - F.col("_upto")).alias("_inside"),
            ),
            "brackets",
        )
        # The next round needs rows of a group once: those inside any of its brackets.
        spans = todo.groupBy(*keys).agg(F.collect_list(F.struct("_low", "_high")).alias("_spans"))  # two for each quantile asked
        path_inside = fresh_path(spark, "rows")
        hit = F.exists("_spans", lambda s: F.col("_v").between(s["_low"], s["_high"]))
        inside = stage_at(_joined(inside, spans, keys).filter(hit).select(*keys, "_v"), path_inside)
        remove(spark, path, *([held] if held else []))
        held = path_inside
    values = stage(reduce(DataFrame.union, done), "values")
    joined = _joined(values, large.select(*keys, "_n"), keys)
    picks = []
    for name, w in place.items():
        part = w - F.floor(w)
        one = lambda r: F.max(F.when(F.col("_rank") == r, F.col("_value")))
        low, high, share = one(F.floor(w) + 1), one(F.least(F.floor(w) + 2, F.col("_n"))), F.max(part)
        picks.append(F.when(share == 0, low).otherwise(low * (1 - share) + high * share).alias(name))
    return joined.groupBy(*keys).agg(*picks)


def _at_rank(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The value at ``_rank`` of each bracket: a window over the distinct values inside, at most as many as the limit."""
    counts = rows.groupBy(*key, "_below", "_v").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*key).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_start", F.col("_below") + F.coalesce(F.sum("_c").over(before), F.lit(0)))
    hit = ranked.filter((F.col("_start") < F.col("_rank")) & (F.col("_rank") <= F.col("_start") + F.col("_c")))
    return hit.select(*key, F.col("_v").alias("_value"))
