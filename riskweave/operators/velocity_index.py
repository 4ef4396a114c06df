"""W1 at fine time units against a stored history: a range-partitioned index of prefix counts.

The index of a history is a table of (k, kv, t, cum), one row per key and distinct time, ``cum`` the key's
events up to and including t. It is sorted by (k, kv, t) and cut into parts of
even size whatever the keys are, so a key with a third of all events spans many parts; a small manifest
holds the first row of each part. A window count is the difference of two look-ups,
cum at t minus cum just before t - w; a look-up is the last row at or before its key and time, and that row
is always in the last part that begins at or before them.

A batch reads only the parts its look-ups fall in. Look-ups of a crowded part are dealt over several tasks, each with
a copy of the part, so copies stay below the number of look-ups; nothing is collected but the manifest.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from ..sources.scratch import materialise
from . import velocity as W
from .evaluate import prefix_sums

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of an index part; look-ups that share one task.
PART_ROWS = 1_000_000


@dataclass
class VelocityIndex:
    rows: DataFrame                      # part, k, kv, t, cum
    first: list[tuple[str, str, int]]    # first key and time of each part, rising
    unit: str

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        spark.createDataFrame([(self.unit, *f) for f in self.first] or [(self.unit, None, None, None)],
                              "unit string, k string, kv string, t long").coalesce(1).write.mode("overwrite").parquet(f"{path}/first")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "VelocityIndex":
        first = spark.read.parquet(f"{path}/first").orderBy("k", "kv", "t").collect()
        rows = spark.read.schema("k string, kv string, t long, cum long, part int").parquet(f"{path}/rows")
        return VelocityIndex(rows, [(r["k"], r["kv"], r["t"]) for r in first if r["k"] is not None], first[0]["unit"])


def build_index(history: DataFrame, date_col: str = "issue_d", keys: Sequence[str] = W.DEFAULT_KEYS, id_col: str = "id",
                unit: str = "micros", part_rows: int = PART_ROWS) -> VelocityIndex:
    """Index of the history's events: one aggregation, one range sort, running sums."""
    keys = [k for k in keys if k in history.columns]
    counts = W.long_events(history, date_col, keys, id_col, unit).groupBy("k", "kv", F.col("day").cast("long").alias("t")) \
        .agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "velocity-counts")
    total = counts.count()
    parts = max(1, -(-total // part_rows))
    summed = prefix_sums(counts, ["k", "kv"], [F.col("t")], ["t"], ["n"], partitions=max(parts, min(shuffle_partitions(history.sparkSession), total or 1)))
    rows = materialise(summed.select("k", "kv", "t", F.col("cum_n").cast("long").alias("cum")), "velocity-sums")
    placed = rows.repartitionByRange(parts, "k", "kv", "t").sortWithinPartitions("k", "kv", "t") \
        .withColumn("part", F.spark_partition_id())
    placed = materialise(placed, "velocity-index")
    first = placed.groupBy("part").agg(F.min(F.struct("k", "kv", "t")).alias("f")).orderBy("part").collect()
    renumber = {r["part"]: i for i, r in enumerate(first)}
    if any(a != b for a, b in renumber.items()):                    # empty parts have no row
        pairs = history.sparkSession.createDataFrame(list(renumber.items()), "part int, now int")
        placed = placed.join(F.broadcast(pairs), "part").drop("part").withColumnRenamed("now", "part")
    return VelocityIndex(placed, [tuple(r["f"]) for r in first], unit)


def _look_up(probes: DataFrame, index: VelocityIndex, part_rows: int) -> DataFrame:
    """Distinct (k, kv, t) -> with ``cum``: the key's events of the history at or before t."""
    first = index.first

    @F.pandas_udf("int")
    def part_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for k, kv, t in batches:
            yield pd.Series([bisect_right(first, p) - 1 for p in zip(k, kv, t)], dtype="int32")

    placed = materialise(probes.withColumn("part", part_of("k", "kv", "t")), "velocity-probes")
    # one row per touched part: at most as many as the manifest has
    shares = placed.where("part >= 0").groupBy("part").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("shares"))
    shares = F.broadcast(materialise(shares, "velocity-shares"))
    asked = placed.join(shares, "part").withColumn("share", F.pmod(F.xxhash64("k", "kv", "t"), F.col("shares")).cast("int"))
    held = index.rows.join(shares, "part").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    none = F.lit(None).cast("long")
    both = held.select("part", "share", "k", "kv", "t", "cum", F.lit(0).alias("kind")).unionByName(
        asked.select("part", "share", "k", "kv", "t", none.alias("cum"), F.lit(1).alias("kind")))
    last = F.last(F.when(F.col("kind") == 0, F.struct("k", "kv", "cum")), ignorenulls=True).over(
        Window.partitionBy("part", "share").orderBy("k", "kv", "t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("last", last).where("kind = 1")
    same = (F.col("last.k") == F.col("k")) & (F.col("last.kv") == F.col("kv"))
    found = found.select("k", "kv", "t", F.when(same, F.col("last.cum")).otherwise(0).alias("cum"))
    return found.unionByName(placed.where("part < 0").select("k", "kv", "t", F.lit(0).cast("long").alias("cum")))


def build_velocity_with_index(batch: DataFrame, index: VelocityIndex, date_col: str = "issue_d",
                              keys: Sequence[str] = W.DEFAULT_KEYS, windows_days: Sequence[int] = W.DEFAULT_WINDOWS,
                              id_col: str = "id", part_rows: int = PART_ROWS) -> DataFrame:
    """Velocity of new rows: history events with the key in [t - w, t], plus earlier rows of the batch (time, id order).

    Rows without key or time get 0, as in ``build_velocity_features``.
    """
    keys = [k for k in keys if k in batch.columns]
    scale = W.UNIT_SCALE[index.unit]
    inside = W.build_velocity_features(batch, date_col, keys, windows_days, id_col, index.unit)
    long = materialise(W.long_events(batch, date_col, keys, id_col, index.unit).withColumn("t", F.col("day").cast("long")).drop("day"), "velocity-batch")
    ends = F.explode(F.array(F.col("t"), *[F.col("t") - F.lit(w * scale) - 1 for w in windows_days])).alias("t")
    cum = materialise(_look_up(long.select("k", "kv", ends).distinct(), index, part_rows), "velocity-found")

    def at(shift: int, name: str) -> DataFrame:
        return cum.select("k", "kv", (F.col("t") + F.lit(shift)).alias("t"), F.col("cum").alias(name))

    times = long.select("k", "kv", "t").distinct().join(at(0, "now"), ["k", "kv", "t"])
    for w in windows_days:
        times = times.join(at(w * scale + 1, f"b{w}"), ["k", "kv", "t"])
    times = times.select("k", "kv", "t", *[(F.col("now") - F.col(f"b{w}")).alias(f"v{w}") for w in windows_days])
    per = long.join(times, ["k", "kv", "t"]).select("_id", "k", *[F.col(f"v{w}").cast("int").alias(f"v{w}") for w in windows_days])
    before = W.pivot_back(batch.select(id_col), per, keys, windows_days, id_col, "hvel")
    names = [f"{k}_{w}d" for k in keys for w in windows_days]
    return inside.join(before, id_col).select(
        *[c for c in batch.columns], *[(F.col(f"vel_{n}") + F.col(f"hvel_{n}")).cast("int").alias(f"vel_{n}") for n in names])
