"""Mixing sources to target weights by systematic sampling, in DataFrame expressions only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share the words of the corpus. A
target stops at ``stop`` times its source's words and the excess goes to the others by weight.

Documents: all of a source have the same expected number of copies, target / source words. Along a fixed order of the
source's documents these expectations are added up from one random offset, and a document is emitted once for each
whole number that the running sum passes. The order goes by size, so neighbours are of like size and the words taken
stay within about one long document of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyward.llm.running import running_totals
from tallyward.sources.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
STOP = 3


def word_count(text: Column) -> Column:
    """Number of words as long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, stop: int = STOP) -> DataFrame:
    """``_source``, ``source_size``, ``target`` for rows with ``_source`` and ``_size``; one row a source, null included.

    Filling goes by size per weight, smallest first: a source stops exactly if the level that the sources not yet
    stopped would share lies above its stop. Two running totals over the sources give all levels at once.
    """
    sources = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    numbered = running_totals(sources, [F.col("_source").asc_nulls_last()], {"_no": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_no") % len(weights) + 1).cast("int"))
    weighed = stage(numbered.withColumn("_weight", weight.cast("long")).drop("_no"), "sources")
    words, weight_sum = weighed.agg(F.sum("source_size"), F.sum("_weight")).first()
    words, weight_sum = words or 0, weight_sum or 0
    order = [(F.col("source_size") / F.col("_weight")).asc(), F.col("_source").asc_nulls_last()]
    filled = running_totals(weighed, order, {"_stops": stop * F.col("source_size"), "_gone": F.col("_weight")})
    level = (F.lit(words) - F.col("_stops")) / (F.lit(weight_sum) - F.col("_gone"))
    stopped = stage(filled.withColumn("_stopped", level * F.col("_weight") > stop * F.col("source_size")), "filled")
    at = F.col("_stopped")
    held, out = stopped.agg(F.sum(F.when(at, stop * F.col("source_size"))), F.sum(F.when(at, F.col("_weight")))).first()
    final = F.lit(words - (held or 0)) / F.lit(weight_sum - (out or 0))
    target = F.when(at, (stop * F.col("source_size")).cast("double")).otherwise(final * F.col("_weight"))
    return stopped.select("_source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    size: Column,
    doc_id: str = "doc_id",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    stop: int = STOP,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes the document).

    Null sources are one source, the last. Null ids rank as the empty string; rows that agree in id and size are
    interchangeable. Sources without words have target 0 and give no copies. Columns of ``docs`` with the names of
    new ones are replaced. Empty tables give empty results. The same input and seed give the same copies.

    Ranks: a source is cut by the leading bits of the size and a hash of the id, so that a source with a third of
    all rows is spread over many tasks; a window ranks inside a cut, and sums over the cuts (a bounded number a
    source) give its start. ``docs`` is read twice; callers stage it where that costs more than writing it.
    """
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    shift = F.greatest(F.length(F.bin("_size")) - 4, F.lit(0))
    sized = docs.withColumns({"_source": F.col(source), "_size": size}).withColumns(
        {
            "_class": F.length(F.bin("_size")) * 16 + F.call_function("shiftright", F.col("_size"), shift).cast("int"),
            "_cut": F.conv(F.substring(F.md5(key), 1, 2), 16, 10).cast("int"),
            "_id": key,
        }
    )
    cuts = sized.groupBy("_source", "_class", "_cut").agg(F.count("*").alias("_rows"), F.sum("_size").alias("_size"))
    cuts = stage(cuts, "cuts")
    earlier = Window.partitionBy("_source").orderBy("_class", "_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = cuts.withColumn("_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows", "_size")
    targets = source_targets(cuts.select("_source", "_size"), weights, stop)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("_source", F.lit("")))), 1, 8), 16, 10)
    targets = targets.withColumn("_offset", offset.cast("double") / F.lit(2.0**32))
    known = starts.alias("a").join(targets.alias("b"), F.col("a._source").eqNullSafe(F.col("b._source")))
    known = known.select("a.*", "b.source_size", "b.target", "b._offset")
    here = Window.partitionBy("_source", "_class", "_cut").orderBy("_size", "_id")
    ranked = sized.withColumn("_rank", F.row_number().over(here)).drop("source_size", "target", "_offset", "_start")
    same = [ranked[c].eqNullSafe(known[c]) for c in ("_source", "_class", "_cut")]
    joined = ranked.join(known, same[0] & same[1] & same[2]).drop(known["_source"], known["_class"], known["_cut"])
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = (F.col("_start") + F.col("_rank")).cast("double")
    passed = F.floor(share * rank + F.col("_offset")) - F.floor(share * (rank - 1) + F.col("_offset"))
    taken = joined.withColumn("copies", F.least(passed, F.ceil(share)).cast("int")).withColumn("size", F.col("_size"))
    return taken.drop("_source", "_size", "_class", "_cut", "_id", "_rank", "_start", "_offset")


def emit(mixed: DataFrame) -> DataFrame:
    """One row for each copy, numbered from 1 in ``copy``; documents without a copy go."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
