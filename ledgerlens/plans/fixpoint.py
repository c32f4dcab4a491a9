"""Repeating a step until nothing changes, with each round's table written to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a folder of our own only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="ledgerlens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside drops its shuffle files at once; else they stay on the disk until the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: a table, as checkpoint() carries the constraints of all rounds along."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own below the shared one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(table: DataFrame) -> None:
    """Deletes the files of a checkpointed() table that nothing reads any more."""
    deleted(table.sparkSession, table._written_at)


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: str, most: int = 1000) -> DataFrame:
    """Applies `step` until no row has `changed` true; `step` keeps that column.  Changes after `most` steps are an error.

    A round's files are deleted when the next one is written.
    """
    state = checkpointed(state)
    for _ in range(most):
        last, state = state, checkpointed(step(state))
        dropped(last)
        if state.filter(changed).limit(1).count() == 0:
            return state
    raise ArithmeticError(f"rows still change after {most} steps")


_SHARED: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, name: str, sf_dir: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A written table that several queries of one application read: built by the first, for tables below sf_dir that don't change meanwhile."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _SHARED:
        _SHARED[key] = checkpointed(build())
    return _SHARED[key]
