"""Secret scans over an incremental ledger of content-addressed blobs.

A path (document id) may have many historical versions; each version's text is a blob named by its SHA-256. The ledger
is a folder with three tables that only grow:

``paths``     (path, blob)                              every version seen, by path
``scanned``   (blob, rule_version)                      pairs that have been scanned
``findings``  (blob, rule_version, kind, start, end)    code points, end exclusive

A run hashes all versions, removes the pairs that the ledger has, and scans each remaining blob once, however many paths
hold it. Findings are joined back to every path. A run is one commit: its files go to a folder of their own, and a marker
that is written last makes it count. A run that dies leaves nothing that a later run would read, and can be run again.
``Ledger.open`` finds the commits of earlier jobs, so a later job scans only what none of them has. Paths have one type
in all commits. Two runs at once may both scan a pair; its findings count once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyward.sources.staging import children, fresh_path, mark, remove, stage_at


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if the text of ``group`` has ``least`` characters. Failing matches are dropped
    after matching, so they still use up the text they cover."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    flags: int = 0


@dataclass(frozen=True)
class RuleSet:
    version: str
    rules: tuple[Rule, ...]

    @property
    def kinds(self) -> list[str]:
        return [r.kind for r in self.rules]


# The patterns of the scan.
BASE_RULES = RuleSet(
    "base-1",
    (
        Rule(
            "assign",
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            8,
            group=2,
            flags=re.IGNORECASE | re.ASCII,
        ),
        Rule("access", r"AKIA[A-Z0-9]+", 16),
        Rule("hex", r"[0-9a-f]{32,}", 32),  # the maximal runs of [0-9a-f]+ that are long enough
    ),
)

FINDING = "blob string, rule_version string, kind string, start long, end long"
TABLES = {"paths": "path string, blob string", "scanned": "blob string, rule_version string", "findings": FINDING}
MARKER = "_committed"


def scan_text(text: str, compiled: list[tuple[Rule, re.Pattern]]) -> list[tuple[str, int, int]]:
    """Spans of all rules in one text."""
    found = []
    for rule, pattern in compiled:
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((rule.kind, m.start(), m.end()))
    return found


def _scan(rule_sets: tuple[RuleSet, ...]):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = {s.version: [(r, re.compile(r.pattern, r.flags)) for r in s.rules] for s in rule_sets}
        for batch in batches:
            rows = [
                (blob, version, kind, start, end)
                for blob, text, version in zip(batch["blob"], batch["text"], batch["rule_version"])
                for kind, start, end in scan_text(text, compiled[version])
            ]
            yield pd.DataFrame(rows, columns=["blob", "rule_version", "kind", "start", "end"])

    return scan


@dataclass
class Ledger:
    """The ledger in ``folder``; ``commits`` are the runs that ended, those of other jobs included."""

    spark: SparkSession
    folder: str
    commits: list[str] = field(default_factory=list)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Ledger:
        """The ledger that earlier jobs left in a shared folder; a folder that is missing is an empty ledger."""
        ledger = cls(spark, folder.rstrip("/"))
        ledger.refresh()
        return ledger

    @classmethod
    def empty(cls, spark: SparkSession) -> Ledger:
        return cls(spark, fresh_path(spark, "ledger"))

    def refresh(self) -> None:
        """See the commits that ended until now."""
        self.commits = sorted(c for c in children(self.spark, self.folder) if f"{c}/{MARKER}" in children(self.spark, c))

    def table(self, name: str) -> DataFrame:
        if not self.commits:
            return self.spark.createDataFrame([], TABLES[name])
        reader = self.spark.read if name == "paths" else self.spark.read.schema(TABLES[name])
        rows = reader.parquet(*(f"{c}/{name}" for c in self.commits))
        return rows.distinct() if name == "findings" and len(self.commits) > 1 else rows

    def scan(self, versions: DataFrame, rule_sets: tuple[RuleSet, ...] = (BASE_RULES,)) -> DataFrame:
        """Scan the blobs in ``versions`` (``path``, ``blob``, ``text``) that the ledger lacks for a rule version.

        Returns the pairs scanned now. ``text`` has no nulls. A blob's text is taken from one version that holds it:
        the (path, blob) pairs are reduced before any text moves, so the shuffle carries each text once. An attempt that
        fails is removed; one whose driver is lost stays without a marker and is never read.
        """
        self.refresh()
        commit = f"{self.folder}/commit-{uuid.uuid4().hex}"
        try:
            scanned = self._scan_into(commit, versions, rule_sets)
            mark(self.spark, f"{commit}/{MARKER}")
        except BaseException:
            remove(self.spark, commit)
            raise
        self.commits.append(commit)
        return scanned

    def _scan_into(self, commit: str, versions: DataFrame, rule_sets: tuple[RuleSet, ...]) -> DataFrame:
        paths = stage_at(versions.select("path", "blob"), f"{commit}/paths")
        named = paths.groupBy("blob").agg(F.min("path").alias("path"))
        wanted = named.withColumn("rule_version", F.explode(F.array(*(F.lit(s.version) for s in rule_sets))))
        unseen = wanted.join(self.table("scanned"), ["blob", "rule_version"], "left_anti")
        pairs = stage_at(unseen, f"{commit}/pairs")
        texts = versions.withColumn("_path", F.col("path")).drop("path")
        # The small side is hashed; texts stream past it without being sorted.
        mine = pairs.groupBy("path", "blob").agg(F.collect_list("rule_version").alias("_versions"))
        mine = mine.withColumnRenamed("path", "_mine").withColumnRenamed("blob", "_blob").hint("shuffle_hash")
        found = texts.join(mine, texts["_path"].eqNullSafe(mine["_mine"]) & (texts["blob"] == mine["_blob"]))
        todo = found.select("blob", "text", F.explode("_versions").alias("rule_version"))
        findings = todo.mapInPandas(_scan(rule_sets), FINDING).distinct()
        stage_at(findings, f"{commit}/findings")
        scanned = stage_at(pairs.select("blob", "rule_version"), f"{commit}/scanned")
        remove(self.spark, f"{commit}/pairs")
        return scanned


def versions_of(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """``path``, ``text`` (null as empty) and ``blob`` (SHA-256 of the UTF-8 text) of each row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(path).alias("path"), whole.alias("text"), F.sha2(whole, 256).alias("blob"))


def spans_by_blob(findings: DataFrame, rule_set: RuleSet = BASE_RULES) -> DataFrame:
    """``blob`` with the count of each kind and ``spans``: ``kind:start:end`` by start, then kind as listed."""
    rows = findings.filter(F.col("rule_version") == rule_set.version)
    rank = F.array_position(F.array(*map(F.lit, rule_set.kinds)), F.col("kind"))
    spans = F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind")))
    joined = F.array_join(F.transform(spans, _span), ",")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in rule_set.kinds]
    return rows.groupBy("blob").agg(*counts, joined.alias("spans"))


def _span(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))


def report(paths: DataFrame, findings: DataFrame, rule_set: RuleSet = BASE_RULES) -> DataFrame:
    """Findings joined back to all paths: a row for each version, those without findings too.

    Findings of a blob fit one row: they are at most a fraction of its text. Paths without findings, the mass, take
    no part in the join but as probes.
    """
    found = paths.join(spans_by_blob(findings, rule_set), "blob", "left")
    counts = [F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in rule_set.kinds]
    return found.select("path", "blob", *counts, F.coalesce("spans", F.lit("")).alias("spans"))


def redacted(docs: DataFrame, findings: DataFrame, text: str = "text", rule_set: RuleSet = BASE_RULES) -> DataFrame:
    """``docs`` with each found span (overlapping ones as one) replaced by its kind in square brackets."""
    spans = F.array_sort(F.collect_list(F.struct("start", "end", "kind")))
    found = findings.filter(F.col("rule_version") == rule_set.version).groupBy("blob").agg(spans.alias("_spans"))
    found = found.withColumnRenamed("blob", "_blob").hint("shuffle_hash")
    joined = docs.withColumn("_of", F.sha2(text, 256)).join(found, F.col("_of") == F.col("_blob"), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(done: Column, s: Column) -> Column:
        before = F.substring(text, (done["at"] + 1).cast("int"), F.greatest(s["start"] - done["at"], F.lit(0)).cast("int"))
        mark = F.when(s["start"] >= done["at"], F.concat(before, F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.concat(done["out"], mark).alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    rest = lambda done: F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))
    whole = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(F.aggregate("_spans", start, step, rest))
    return joined.withColumn(text, whole).select(docs.columns)
