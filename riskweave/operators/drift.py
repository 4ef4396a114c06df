"""Population stability (PSI) drift monitoring.

Reference fit (D2): per feature, the 9 inner decile edges of the reference
sample (exact order statistics, all features in one sort) and the expected
share of each of the 10 left-closed bins [e_i, e_i+1) (outer edges -inf/+inf).
The fitted state is a small table (feature, bin, expected_pct) plus the edges.

Report (D3): the current frame is unpivoted to (feature, value); each value
is binned against its feature's edges (a broadcast table with one row per
feature), counted per (feature, bin) in one grouped aggregation for all
features, completed to 10 bins, floored at 1e-6 and summed into
sum((a - e) * ln(a / e)). Features need >= 10 non-null current values;
alert = psi > 0.2; sorted by psi descending.

Stated difference: the reference samples 50,000 reference rows; here the
edges and shares use every row (no sample is needed at this cost).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .ordering import MANY_COLUMNS, quantiles

N_BINS = 10
FLOOR = 1e-6
ALERT = 0.2
MIN_CURRENT = 10


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols]))
    return df.select(kv.alias("e")).select("e.feature", "e.x").where(F.col("x").isNotNull() & ~F.isnan("x"))


def _binned(long: DataFrame, edges: DataFrame) -> DataFrame:
    # bin = number of inner edges <= x  (np.histogram with +-inf outer edges)
    return (long.join(F.broadcast(edges), "feature")
            .select("feature", F.size(F.filter("edges", lambda e: e <= F.col("x"))).alias("bin")))


def _bin_counts(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """(feature, bin, c): values of every feature per bin of its edges, a few rows per task and feature."""
    cols = list(edges)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = [np.zeros(len(edges[c]) + 1, dtype=np.int64) for c in cols]
        for batch in batches:
            for i, c in enumerate(cols):
                v = batch.iloc[:, i].to_numpy(dtype=float)
                v = v[~np.isnan(v)]                  # NULL comes as NaN
                at = np.zeros(len(v), dtype=np.int64)
                for e in edges[c]:
                    at += v >= e
                counts[i] += np.bincount(at, minlength=len(counts[i]))
        found = [(c, b, int(k)) for c, per_bin in zip(cols, counts) for b, k in enumerate(per_bin) if k]
        yield pd.DataFrame(found, columns=["feature", "bin", "c"])

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).mapInPandas(work, "feature string, bin int, c long")
    return parts.groupBy("feature", "bin").agg(F.sum("c").alias("c"))


def _shares(binned: DataFrame) -> DataFrame:
    return _shares_of(binned.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("c")))


def _shares_of(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("feature").agg(F.sum("c").alias("n"))
    grid = totals.select("feature", "n", F.explode(F.sequence(F.lit(0), F.lit(N_BINS - 1))).alias("bin"))
    return (grid.join(counts, ["feature", "bin"], "left")
            .select("feature", "bin", "n", F.greatest(F.coalesce(F.col("c"), F.lit(0)) / F.col("n"), F.lit(FLOOR))
                    .alias("pct")))


@dataclass
class DriftReference:
    edges: DataFrame          # feature, edges array<double> (9 inner edges)
    expected: DataFrame       # feature, bin, expected_pct

    def save(self, path: str) -> None:
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")
        self.expected.write.mode("overwrite").parquet(f"{path}/expected")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "DriftReference":
        return DriftReference(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/expected"))

    def psi_report(self, current: DataFrame, alert: float = ALERT, min_current: int = MIN_CURRENT) -> DataFrame:
        """D3: feature, psi, alert (sorted by psi descending)."""
        feats = [r["feature"] for r in self.edges.select("feature").collect()]
        cols = [c for c in feats if c in current.columns]
        if not cols:
            return current.sparkSession.createDataFrame([], "feature string, psi double, alert boolean")
        act = _shares(_binned(_long(current, cols), self.edges))
        j = (act.where(F.col("n") >= min_current)
             .join(self.expected, ["feature", "bin"])
             .groupBy("feature")
             .agg(F.sum((F.col("pct") - F.col("expected_pct")) * F.log(F.col("pct") / F.col("expected_pct")))
                  .alias("psi")))
        return j.withColumn("alert", F.col("psi") > F.lit(alert)).orderBy(F.desc("psi"))


def fit_reference(df: DataFrame, cols: Sequence[str], bins: int = N_BINS, stored: bool | None = None) -> DriftReference:
    """Decile edges and expected bin shares for every column (one sort for all); ``stored`` as for ``quantiles``,
    unless given it holds for ``stored_columns``.

    The shares of many columns are counted column by column: unpivoted, every value is a row that goes through a join."""
    spark = df.sparkSession
    stored = vars(df).get("_stored", False) if stored is None else stored
    q = quantiles(df, list(cols), [i / bins for i in range(1, bins)], stored=stored)
    rows = [(c, [float(e) for e in q[c]]) for c in cols if q[c][0] is not None]
    edges = spark.createDataFrame(rows, "feature string, edges array<double>")
    counted = (_shares_of(_bin_counts(df, dict(rows))) if len(rows) >= MANY_COLUMNS
               else _shares(_binned(_long(df, [r[0] for r in rows]), edges)))
    expected = counted.select("feature", "bin", F.col("pct").alias("expected_pct"))
    return DriftReference(edges, materialise(expected, "drift-expected"))


def psi_of_long(expected: DataFrame, current: DataFrame, bins: int = N_BINS, alert: float = ALERT,
                min_current: int = MIN_CURRENT) -> DataFrame:
    """D2 and D3 on long rows (feature, x): any number of features, none of them known to the driver.

    The decile edges of a feature are interpolated between the values at two
    ranks. Values are counted first (one row per feature and distinct value), so
    a feature that holds most rows is spread over the order's range partitions.
    """
    from .evaluate import prefix_sums
    known = F.col("x").isNotNull() & ~F.isnan("x") & F.col("feature").isNotNull()
    exp = materialise(expected.where(known).groupBy("feature", F.col("x").cast("double").alias("x"))
                      .agg(F.count(F.lit(1)).cast("double").alias("c")), "drift-values")
    cum = prefix_sums(exp, ["feature"], [F.col("x")], ["x"], ["c"])
    totals = exp.groupBy("feature").agg(F.sum("c").alias("n"))
    at = F.explode(F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("p")
    wanted = totals.select("feature", "n", at).withColumn("h", (F.col("n") - 1) * F.col("p")) \
        .withColumn("lo", F.floor("h")).withColumn("hi", F.ceil("h"))
    def holds(rank: str) -> Column:
        return F.max(F.when((F.col("cum_c") - F.col("c") <= F.col(rank)) & (F.col(rank) < F.col("cum_c")), F.col("x")))
    # the (at most 2 (bins - 1)) values that hold a wanted rank, by feature
    cut = cum.join(wanted, "feature").where(
        ((F.col("cum_c") - F.col("c") <= F.col("lo")) & (F.col("lo") < F.col("cum_c")))
        | ((F.col("cum_c") - F.col("c") <= F.col("hi")) & (F.col("hi") < F.col("cum_c"))))
    edges = cut.groupBy("feature", "p").agg(holds("lo").alias("a"), holds("hi").alias("b"), F.first(F.col("h") - F.col("lo")).alias("f")) \
        .groupBy("feature").agg(F.array_sort(F.collect_list(F.round(F.col("a") + (F.col("b") - F.col("a")) * F.col("f"), 6))).alias("edges"))
    edges = materialise(edges, "drift-edges")

    def shares(values: DataFrame, name: str) -> DataFrame:
        b = values.join(edges, "feature").select("feature", "c", F.size(F.filter("edges", lambda e: e <= F.col("x"))).alias("bin"))
        counts = b.groupBy("feature", "bin").agg(F.sum("c").alias("c"))
        grid = counts.groupBy("feature").agg(F.sum("c").alias("n")).select(
            "feature", "n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        return grid.join(counts, ["feature", "bin"], "left").select(
            "feature", "bin", F.col("n").alias(f"n_{name}"),
            F.greatest(F.coalesce(F.col("c"), F.lit(0.0)) / F.col("n"), F.lit(FLOOR)).alias(name))

    cur = current.where(known).groupBy("feature", F.col("x").cast("double").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    e, a = shares(exp, "e"), shares(cur, "a").where(F.col("n_a") >= min_current)
    psi_value = F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e")))
    return a.join(e, ["feature", "bin"]).groupBy("feature").agg(psi_value.alias("psi")) \
        .withColumn("alert", F.col("psi") > F.lit(alert))


def psi(expected: DataFrame, actual: DataFrame, col: str, bins: int = N_BINS) -> float | None:
    """PSI of one column between two frames."""
    ref = fit_reference(expected, [col], bins)
    rows = ref.psi_report(actual, min_current=0).collect()
    return rows[0]["psi"] if rows else None


def alert_summary(report: DataFrame, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """(number of alerts, top ``top`` features by psi)."""
    return (report.agg(F.sum(F.col("alert").cast("int")).alias("n_alerts"), F.count(F.lit(1)).alias("n_features")),
            report.orderBy(F.desc("psi"), "feature").limit(top))
