"""Intermediate tables in the session's shared scratch folder.

``materialise`` writes a frame as Parquet below the reliable checkpoint
directory (a shared folder on a cluster) and reads it back: the lineage is cut,
later jobs prune columns and push filters into the files, and a lost executor
re-reads them. ``discard`` deletes such a table once no later frame needs it.
Inside ``scratch_scope`` every such table is deleted at the end, which long-running
streams need: one scope per micro-batch keeps the folder's size constant.
``side_by_side`` runs independent steps at the same time, for steps of many short jobs.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_SCOPE = threading.local()
MAX_AT_ONCE = 6     # steps that run at the same time; each keeps what it persists until it ends


def materialise(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if getattr(_SCOPE, "written", None) is not None:
        _SCOPE.written.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def stored_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Columns of a written table, marked as such: passes over them need not write them again."""
    out = df.select(*cols)
    out._stored = True
    return out


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    remove_folder(df.sparkSession, df._scratch_path)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Deletes what ``materialise`` writes inside the block; write what must stay elsewhere before it ends."""
    outer = getattr(_SCOPE, "written", None)
    _SCOPE.written = mine = []
    try:
        yield
    finally:
        _SCOPE.written = outer
        for spark, path in mine:
            remove_folder(spark, path)


def side_by_side(spark: SparkSession, steps: Iterable[Callable], at_once: int = MAX_AT_ONCE) -> list:
    """The results of independent steps in their order, each run from a driver thread of its own.

    The steps' Spark jobs share the executors, so one step's scheduling does not leave them idle.
    What the steps materialise belongs to the caller's ``scratch_scope``.
    """
    scope = getattr(_SCOPE, "written", None)

    def run(step: Callable):
        _SCOPE.written = scope
        return step()

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return [r.result() for r in [pool.submit(inheritable_thread_target(spark)(run), s) for s in steps]]
