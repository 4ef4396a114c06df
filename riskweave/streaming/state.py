"""State that a stream keeps between micro-batches, as tables of mergeable rows.

An ``EpochTable`` holds one folder of rows per epoch (micro-batch number) and now and then
a base that merges all epochs before it. Rows merge by an aggregation that does not care for order or
grouping (sums, minima), so base plus later epochs always means the same.

Exactly once: an epoch reads only what earlier epochs left and writes only its
own folder. A micro-batch that was cut short is run again by Structured Streaming
with the same number; it sees the same state and replaces its own rows. A folder
counts once its ``_SUCCESS`` marker is there, so half-written ones are never read.

The state belongs to one checkpoint location: keep or drop both together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import remove_folder

Merge = Callable[[DataFrame], DataFrame]


class EpochTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Merge, compact_every: int = 16,
                 sort_by: tuple[str, ...] = ()):
        """``sort_by``: columns that a base is range-partitioned and sorted by, so filters on them skip files."""
        self.spark, self.path, self.schema, self.merge = spark, path.rstrip("/"), schema, merge
        self.compact_every, self.sort_by = compact_every, sort_by

    def _complete(self, kind: str) -> list[int]:
        """Numbers of the finished folders of a kind ("epoch" or "base")."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        found = [s.getPath() for s in fs.listStatus(top)]
        return sorted(int(p.getName()) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _parts(self, epoch: int) -> tuple[int, list[int]]:
        base = max((b for b in self._complete("base") if b <= epoch), default=0)
        return base, [e for e in self._complete("epoch") if base <= e < epoch]

    def rows_before(self, epoch: int) -> DataFrame:
        """Unmerged rows of all epochs before ``epoch``; filter them before ``merge`` where possible."""
        base, later = self._parts(epoch)
        folders = ([f"{self.path}/base/{base}"] if base else []) + [f"{self.path}/epoch/{e}" for e in later]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders \
            else self.spark.createDataFrame([], self.schema)

    def before(self, epoch: int) -> DataFrame:
        return self.merge(self.rows_before(epoch))

    def put(self, epoch: int, rows: DataFrame) -> None:
        """The epoch's rows; putting them again replaces them. Compacts older epochs when enough have come together."""
        rows.write.mode("overwrite").parquet(f"{self.path}/epoch/{epoch}")
        if epoch and len(self._parts(epoch)[1]) >= self.compact_every:
            self.compact(epoch)

    def compact(self, epoch: int) -> None:
        """Merge all epochs before ``epoch`` into a base, then drop what it replaces.

        The epochs are finished (a later one runs), so none of them is written again. A crash before the
        base is complete leaves it unread; one while dropping leaves folders that the base already hides.
        """
        merged = self.before(epoch)
        if self.sort_by:
            merged = merged.repartitionByRange(*self.sort_by).sortWithinPartitions(*self.sort_by)
        merged.write.mode("overwrite").parquet(f"{self.path}/base/{epoch}")
        for kind, number in [("base", b) for b in self._complete("base") if b < epoch] + \
                            [("epoch", e) for e in self._complete("epoch") if e < epoch]:
            remove_folder(self.spark, f"{self.path}/{kind}/{number}")
