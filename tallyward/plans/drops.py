"""A count panel that grows by files: every file is counted once, later drops and corrections are added to what is there.

A run is one commit: the versions of files it counted and their counts, in a folder of its own, with a marker written last.
Folders without the marker are never read, so a run that died leaves nothing behind that counts. Of each path the version
added last is current; counts keep their path, so a corrected file replaces its older counts and nothing else. Where two
runs at once counted the same version, one of them is read. A file that is no longer there stays counted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyward.operators.counts import count_by
from tallyward.operators.rows import keep_values
from tallyward.plans.panel import CELL, CountPanel, panel_of_counts, usable_incidents
from tallyward.sources.files import list_files, read_incident_files
from tallyward.sources.staging import children, mark, remove, stage_at

MARKER = "_committed"
VERSION = ["path", "size", "changed"]
FILES = "path string, size long, changed timestamp, added long, commit string"
COUNTS = "commit string, path string, reported_by string, category string, month string, area_code string, year string, n long"

Reader = Callable[[SparkSession, Sequence[str]], DataFrame]


@dataclass(frozen=True)
class PanelFiles:
    """The commits in ``folder``, those of other jobs included."""

    spark: SparkSession
    folder: str

    def commits(self) -> list[str]:
        """Folders of the runs that ended."""
        return sorted(c for c in children(self.spark, self.folder) if f"{c}/{MARKER}" in children(self.spark, c))

    def _read(self, commits: Sequence[str], name: str, schema: str) -> DataFrame:
        if not commits:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{c}/{name}" for c in commits))

    def files(self, commits: Sequence[str] | None = None) -> DataFrame:
        """The current version of each path: ``path``, ``size``, ``changed``, ``added``, ``commit``."""
        versions = self._read(self.commits() if commits is None else commits, "files", FILES)
        newest = F.max(F.struct("added", "commit", "size", "changed")).alias("v")
        return versions.groupBy("path").agg(newest).select("path", "v.size", "v.changed", "v.added", "v.commit")

    def counts(self) -> DataFrame:
        """``commit``, ``path``, ``reported_by``, the columns of a cell and ``n``, of current versions only.

        What is left out is a short list, versions that were replaced, so the counts are not shuffled for it.
        """
        commits = self.commits()
        found = self._read(commits, "counts", COUNTS)
        if len(commits) < 2:
            return found
        place = ["commit", "path"]
        replaced = self._read(commits, "files", FILES).select(*place).join(self.files(commits).select(*place), place, "left_anti")
        return found.join(replaced, place, "left_anti")

    def add(self, roots: str | Sequence[str], name_glob: str = "*street.csv", read: Reader = read_incident_files) -> int:
        """Count the files below ``roots`` that are new or have changed; returns how many.

        ``read`` takes paths and returns incidents with ``file_path``, ``reported_by`` and the columns of a cell. A file is
        known by path, size and time. Without new files nothing is written.
        """
        before = self.commits()
        current = self.files(before)
        new = list_files(self.spark, roots, name_glob).join(current.select(*VERSION), VERSION, "left_anti")
        commit = f"commit-{uuid.uuid4().hex}"
        at = f"{self.folder}/{commit}"
        try:
            added = (current.agg(F.max("added")).first()[0] or 0) + 1
            files = stage_at(new.select(*VERSION, F.lit(added).cast("long").alias("added"), F.lit(commit).alias("commit")), f"{at}/files")
            paths = [unquote(r.path) for r in files.select("path").collect()]
            if paths:
                rows = read(self.spark, paths).withColumnRenamed("file_path", "path")
                self._write(count_by(rows, ["path", "reported_by", *CELL]), at, commit)
                mark(self.spark, f"{at}/{MARKER}")
        except BaseException:
            remove(self.spark, at)
            raise
        if not paths:
            remove(self.spark, at)
        return len(paths)

    def _write(self, counts: DataFrame, at: str, commit: str) -> None:
        rows = counts.select(F.lit(commit).alias("commit"), "path", "reported_by", *CELL, "n")
        stage_at(rows.sortWithinPartitions("year", "month", "category"), f"{at}/counts")

    def compact(self) -> None:
        """Put all commits into one, so that reading opens few files; not while another job reads or adds.

        The new commit holds the same versions, so results are the same at every step, also if this run dies half way.
        """
        before = self.commits()
        if len(before) < 2:
            return
        commit = f"commit-{uuid.uuid4().hex}"
        at = f"{self.folder}/{commit}"
        try:
            stage_at(self.files(before).withColumn("commit", F.lit(commit)), f"{at}/files")
            self._write(self.counts().hint("rebalance"), at, commit)
            mark(self.spark, f"{at}/{MARKER}")
        except BaseException:
            remove(self.spark, at)
            raise
        for old in before:
            remove(self.spark, f"{old}/{MARKER}")
            remove(self.spark, old)

    def panel(
        self,
        boundaries: DataFrame,
        excluded_providers: Sequence[str],
        label_pattern: str,
        prefix: str,
        years: Sequence[str] | None = None,
    ) -> CountPanel:
        """The panel of all files counted so far, as ``build_panel`` gives it from their rows."""
        counts = self.counts() if years is None else keep_values(self.counts(), "year", years)
        cells = usable_incidents(counts, excluded_providers).groupBy(*CELL).agg(F.sum("n").alias("n"))
        return panel_of_counts(cells, boundaries, label_pattern, prefix)
