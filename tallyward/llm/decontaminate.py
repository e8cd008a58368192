"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame expressions only.

A document leaks an item if one of its windows of the item's number of words has a weighted-shingle similarity of at least
``SIMILAR`` with it: the sum of the smaller over the sum of the larger counts of each shingle, over word shingles of five.
Of a document shorter than the item the whole document is the window.

1. *Windows.* A window of w shingles and an item of n need at least (w + n)t / (1 + t) of the window's shingles in the
   item for a similarity t, and w >= nt. Only windows with so many shingles of any items of n are kept. This loses no window
   that the last step would accept; it spares the fingerprints of windows that match nothing. Which item it is stays open, so
   a line that many documents and items have in common gives a row for each size of item, not for each item.
2. *Fingerprints.* Windows and items get a 64-bit SimHash of their shingles with their multiplicities. Windows of the same
   shingles, in however many documents, are one class from here on.
3. *Multi-index.* Fingerprints are cut into ``BLOCKS`` blocks. Two within ``RADIUS`` bits differ by at most
   ``RADIUS // BLOCKS`` bits in some block, so items are entered under all values that near, and windows probe with theirs.
   Every pair of one size within the radius meets. Without repeated shingles a similarity of 0.8 leads to a mean of 9.7
   bits with a deviation of 2.9, whatever the size; the radius is 4.6 deviations above.
   *Repeats.* Where a shingle repeats, few hashes can decide all bits (an item ``x y x y ...`` against ``y x y x ...``), and
   the distance says nothing. Pairs of which either side repeats a shingle meet by the rarest of their shingles instead: of
   the w and n occurrences, ordered by use in the benchmark, w - need + 1 and n - need + 1 are enough to share one.
4. *Verification.* Pairs are compared exactly by the counts of their shingles.

Items with the same words are one class until the end. Benchmark shingles are broadcast in blocks of at most
``MOST_BROADCAST`` rows, one pass over the documents for each, so what is sent has a bound whatever the benchmark's size.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tallyward.llm.marks import text_mark
from tallyward.sources.staging import stage

SHINGLE = 5
SIMILAR = 0.8
BLOCKS = 8
RADIUS = 23
MOST_BROADCAST = 1 << 20
_BITS = 64 // BLOCKS


def words(text: Column) -> Column:
    """Lower-case words; null text has none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def shingles(tokens: Column, size: int) -> Column:
    """Hash of each run of ``size`` words."""
    last = F.size(tokens) - size + 1
    each = lambda i: F.xxhash64(*(F.get(tokens, i + j) for j in range(size)))
    return F.when(last > 0, F.transform(F.sequence(F.lit(0), last - 1), each)).otherwise(F.array().cast("array<long>"))


def tokens_of(rows: DataFrame) -> DataFrame:
    """``tokens`` as a column of its own, so that they are made once and not for each shingle."""
    return rows.withColumn("tokens", words(F.col("text")))


def near_values(reach: int) -> list[int]:
    """All ways to flip at most ``reach`` bits of a block."""
    return [sum(1 << b for b in flips) for n in range(reach + 1) for flips in combinations(range(_BITS), n)]


def block(fingerprint: Column, number: int) -> Column:
    return F.shiftrightunsigned(fingerprint, number * _BITS).bitwiseAND((1 << _BITS) - 1).cast("int")


def simhash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``fp`` of each group of ``h``: a bit is set if more than half of the hashes have it.

    A sum counts two bits, 32 apart, in its halves; a text has fewer than 2**31 shingles, so no half overflows.
    """
    votes = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(1 << 32 | 1)).alias(f"_v{b}") for b in range(32)]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *votes)
    half = lambda b: F.col(f"_v{b}").bitwiseAND((1 << 32) - 1) if b < 32 else F.shiftrightunsigned(f"_v{b - 32}", 32)
    one = lambda b: F.when(half(b) * 2 > F.col("_n"), F.lit((1 << b) - (1 << 64) * (b == 63))).otherwise(F.lit(0).cast("long"))
    return counted.select(*keys, reduce(Column.bitwiseOR, map(one, range(64))).alias("fp"))


def item_classes(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item`` (the class: its smallest id), ``tokens`` and ``ids`` of the items that have words."""
    rows = items.select(F.col(item_id).alias("id"), words(F.col(text)).alias("tokens")).filter("size(tokens) > 0 AND id IS NOT NULL")
    return rows.groupBy("tokens").agg(F.min("id").alias("item"), F.collect_set("id").alias("ids"))


def leaks(docs: DataFrame, items: DataFrame, similar: float = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The best window of each document and item that it leaks: ``doc_id``, ``item_id``, ``start`` (word, from 0),
    ``n_words`` (of the window), ``similarity``, ``distance`` (bits), and ``mark``, which tells rows of one id with other texts apart.

    Items of fewer than five words are compared as one shingle of their words. Items and documents without words and
    items without an id match nothing; a null document id is kept. Of equal windows the first counts. Rows that repeat
    a document give one result.
    """
    classes = stage(item_classes(items), "items")
    sizes = [r[0] for r in classes.select(F.least(F.size("tokens"), F.lit(SHINGLE)).alias("k")).distinct().collect()]
    # A struct with a null id equals another such, so null ids need no care in joins.
    doc = F.struct(F.col(doc_id).alias("doc_id")).alias("doc")
    rows = docs.select(doc, text_mark(F.col(text)).alias("mark"), F.col(text).alias("text"))
    found = [_leaks_of_size(rows, classes.filter(F.least(F.size("tokens"), F.lit(SHINGLE)) == k), k, similar) for k in sorted(sizes)]
    if not found:
        empty = rows.select("doc.doc_id", "mark", F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"), F.lit(0).alias("distance"))
        return empty.join(items.select(F.col("item_id")), F.lit(False)).limit(0)
    best = F.max(F.struct("similarity", -F.col("start"), "n_words", "distance")).alias("best")
    pairs = reduce(DataFrame.union, found).groupBy("doc", "mark", "item").agg(best)
    named = pairs.join(classes.select("item", F.explode("ids").alias("item_id")), "item")
    start = (-F.col("best")["col2"]).alias("start")
    return named.select("doc.doc_id", "mark", "item_id", start, "best.n_words", "best.similarity", "best.distance")


def _leaks_of_size(rows: DataFrame, classes: DataFrame, k: int, similar: float) -> DataFrame:
    hashed = classes.select("item", shingles(F.col("tokens"), k).alias("hashes")).withColumn("n", F.size("hashes"))
    own = stage(hashed.select("item", "n", _repeats(F.col("hashes")).alias("repeats"), F.explode("hashes").alias("h")), "item-shingles")
    known = stage(own.groupBy("h").agg(F.count("*").alias("uses")), "known")
    blocks = max(1, -(-known.count() // MOST_BROADCAST))
    m = F.greatest(F.size("tokens") - (k - 1), F.lit(0)).alias("m")  # from the tokens: a column of hashes stalls the optimizer
    each = tokens_of(rows).select("doc", "mark", m, F.posexplode(shingles(F.col("tokens"), k)).alias("pos", "h"))
    hits = None
    for b in range(blocks):  # a block has at most about MOST_BROADCAST rows
        part = F.broadcast(known.filter(F.pmod("h", F.lit(blocks)) == b).select("h"))
        met = each.join(part, "h", "left_semi")
        hits = met if hits is None else hits.union(met)
    hits = stage(hits, "hits").distinct()

    # Windows with enough hits, from the sorted places in a document of shingles that items of a size have.
    need = F.greatest(F.ceil((F.col("w") + F.col("n")) * (similar / (1 + similar)) - 1e-9).cast("int"), F.lit(1))
    met = hits.join(own.select("n", "h").distinct(), "h").withColumn("w", F.least("n", "m")).filter(F.col("w") >= F.col("n") * similar - 1e-9)
    places = met.groupBy("doc", "mark", "n", "w").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    places = places.withColumn("need", need).filter("size(at) >= need")
    span = "transform(sequence(need - 1, size(at) - 1), i -> struct(greatest(at[i] - w + 1, 0) AS a, at[i - need + 1] AS b))"
    ranges = places.withColumn("r", F.explode(F.expr(span))).filter("r.a <= r.b")
    windows = ranges.select("doc", "mark", "n", "w", F.explode(F.sequence("r.a", "r.b")).alias("start")).distinct()
    windows = stage(windows, "windows")

    # Candidate documents' shingles; the windows are hashed, texts stream past them.
    wanted = windows.groupBy("doc", "mark").agg(F.collect_list(F.struct("n", "w", "start")).alias("win"))
    texts = rows.join(wanted.hint("shuffle_hash"), ["doc", "mark"])
    texts = tokens_of(texts).select("doc", "mark", shingles(F.col("tokens"), k).alias("hashes"), "win")
    cut = texts.select("doc", "mark", F.explode("win").alias("win"), "hashes").filter("win.start + win.w <= size(hashes)")
    cut = cut.select("doc", "mark", "win.*", F.slice("hashes", F.col("win.start") + 1, F.col("win.w")).alias("hashes"))
    cut = cut.withColumn("cls", F.struct(F.xxhash64("hashes", "n").alias("a"), F.xxhash64(F.lit("second"), "hashes", "n").alias("b")))
    cut = stage(cut, "cut")
    kinds = cut.groupBy("cls").agg(F.first("n").alias("n"), F.first("w").alias("w"), F.first("hashes").alias("hashes"))
    kinds = stage(kinds.withColumn("repeats", _repeats(F.col("hashes"))).withColumn("need", need), "window-classes")

    # Written once, so that no later plan, which the driver holds, has the steps before it again.
    item_prints = stage(simhash(own, ["item", "n", "repeats"]), "item-prints")
    found = _by_index(kinds.filter("NOT repeats"), item_prints.filter("NOT repeats")).union(_by_rare_shingles(kinds, own, known, similar))
    found = stage(found.distinct(), "candidates")

    # Exact similarity of each class and item, then of each window.
    candidates = kinds.join(found, "cls").select("cls", "item", "n", "w", F.explode("hashes").alias("h"))
    counts = candidates.groupBy("cls", "item", "n", "w", "h").agg(F.count("*").alias("c"))
    item_counts = own.groupBy("item", "h").agg(F.count("*").alias("d"))
    both = counts.join(item_counts, ["item", "h"]).groupBy("cls", "item", "n", "w").agg(F.sum(F.least("c", "d")).alias("same"))
    similarity = F.col("same") / (F.col("w") + F.col("n") - F.col("same"))
    alike = both.select("cls", "item", similarity.alias("similarity")).filter(F.col("similarity") >= similar)
    alike = stage(alike, "alike")
    prints = simhash(kinds.join(alike.select("cls").distinct(), "cls", "left_semi").select("cls", F.explode("hashes").alias("h")), ["cls"])
    alike = alike.join(prints, "cls").join(item_prints.select("item", F.col("fp").alias("item_fp")), "item")
    alike = alike.select("cls", "item", "similarity", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("distance"))
    return cut.select("doc", "mark", "cls", "start", (F.col("w") + (k - 1)).alias("n_words")).join(stage(alike, "distances"), "cls").select(
        "doc", "mark", "item", "start", "n_words", "similarity", "distance"
    )


def _repeats(hashes: Column) -> Column:
    return F.size(F.array_distinct(hashes)) < F.size(hashes)


def _by_index(kinds: DataFrame, item_prints: DataFrame) -> DataFrame:
    """``cls`` and ``item`` of window classes and items of one size within the radius, through the index."""
    prints = stage(simhash(kinds.select("cls", "n", F.explode("hashes").alias("h")), ["cls", "n"]), "prints")
    values = F.array(*(F.lit(v) for v in near_values(RADIUS // BLOCKS)))
    entries = F.explode(F.array(*(F.struct(F.lit(i).alias("block"), block(F.col("fp"), i).alias("value")) for i in range(BLOCKS))))
    index = item_prints.select("item", "n", F.col("fp").alias("item_fp"), entries.alias("e"))
    index = index.select("item", "n", "item_fp", "e.block", F.explode(F.transform(values, lambda v: v.bitwiseXOR(F.col("e.value")))).alias("value"))
    probes = prints.select("n", "fp").distinct().select("n", "fp", entries.alias("e")).select("n", "fp", "e.block", "e.value")
    close = probes.join(index, ["n", "block", "value"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    return prints.join(close.select("n", "fp", "item").distinct(), ["n", "fp"]).select("cls", "item")


def _by_rare_shingles(kinds: DataFrame, own: DataFrame, known: DataFrame, similar: float) -> DataFrame:
    """``cls`` and ``item`` of all pairs that can reach the similarity and of which one side repeats a shingle."""
    least = F.ceil(F.col("n") * similar - 1e-9).cast("int")  # of the shortest window that counts
    order = F.sort_array(F.collect_list(F.struct("uses", "h", "c")))  # occurrences of a shingle, one by one
    one_by_one = F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("c")
    counted = own.groupBy("item", "n", "repeats", "h").agg(F.count("*").alias("c")).join(known, "h")
    rare = counted.select("item", "n", "repeats", "h", "uses", one_by_one).groupBy("item", "n", "repeats").agg(order.alias("o"))
    rare = stage(rare.select("item", "n", "repeats", F.explode(F.slice("o", 1, F.col("n") - least + 1)).alias("e")), "rare")

    # Windows without repeats matter only to items with repeats, of their size.
    sizes = rare.filter("repeats").select("n").distinct()
    mine = kinds.filter("repeats").unionByName(kinds.filter("NOT repeats").join(sizes, "n", "left_semi"))
    shingled = mine.select("cls", "n", "w", "need", "repeats", F.explode("hashes").alias("h"))
    shingled = shingled.groupBy("cls", "n", "w", "need", "repeats", "h").agg(F.count("*").alias("c"))
    shingled = shingled.join(known, "h", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    probes = shingled.select("cls", "n", "w", "need", "repeats", "h", "uses", one_by_one).groupBy("cls", "n", "w", "need", "repeats").agg(order.alias("o"))
    probes = probes.select("cls", "n", F.col("repeats").alias("mine"), F.explode(F.slice("o", 1, F.col("w") - F.col("need") + 1)).alias("e")).filter("e.uses > 0")
    return probes.join(rare, ["n", "e"]).filter("mine OR repeats").select("cls", "item")
