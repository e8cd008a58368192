"""Shared-folder tables that cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
SHUFFLE_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# A scan never cuts a file inside a row group, so what one task wrote into one file one task would read.
FILE_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one is set only in local mode."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_SETTING} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyward-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tallyward/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffle_files_freed(spark: SparkSession) -> Iterator[None]:
    """Free the shuffle files of each execution inside as soon as it ends."""
    before = spark.conf.get(SHUFFLE_CLEANUP_SETTING, "false")
    spark.conf.set(SHUFFLE_CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP_SETTING, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and return a scan of it.

    Used where a result is read several times: each later read is a columnar scan with
    pushdown instead of a recomputation of everything above it.
    """
    return stage_at(df, fresh_path(df.sparkSession, label))


def stage_at(df: DataFrame, path: str) -> DataFrame:
    """As ``stage``, at a path that the caller knows and can ``remove`` when no later step reads it.

    Files have at most ``FILE_ROWS`` rows, so many tasks share the later scan also of what few tasks wrote.
    """
    spark = df.sparkSession
    with shuffle_files_freed(spark):
        df.write.option("maxRecordsPerFile", FILE_ROWS).mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Paths directly below a folder; none if it is missing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f"{path}/{s.getPath().getName()}" for s in files.listStatus(where)] if files.exists(where) else []


def mark(spark: SparkSession, path: str) -> None:
    """An empty file, the last step of a commit."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(where):
        raise FileExistsError(path)
