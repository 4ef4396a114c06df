"""Decisions and score reports over a scored frame.

All are projections or small grouped aggregations; bucket indexes are
computed arithmetically per row, so histograms are one partial aggregation
plus a running sum over at most a few dozen rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .behavior import qcut_edges, qcut_label
from .ordering import quantiles

# Decision thresholds and histogram layouts.
REVIEW_THRESHOLD = 0.3
DECLINE_THRESHOLD = 0.7
HISTOGRAM_BOUNDS = 20      # cumulative bounds i/20, i = 0..20, then +inf
DASHBOARD_BINS = 40


def decision(score: str | Column, review: float = REVIEW_THRESHOLD, decline: float = DECLINE_THRESHOLD) -> Column:
    """DECLINE at >= decline, REVIEW at >= review, else APPROVE (on the unrounded score)."""
    s = F.col(score) if isinstance(score, str) else score
    return (F.when(s >= F.lit(decline), "DECLINE").when(s >= F.lit(review), "REVIEW").otherwise("APPROVE"))


def band(df: DataFrame, score: str = "score", review: float = REVIEW_THRESHOLD,
         decline: float = DECLINE_THRESHOLD) -> DataFrame:
    """Decision, then the score rounded to 6 decimals, plus the thresholds used."""
    return (df.withColumn("decision", decision(score, review, decline))
            .withColumn("fraud_score", F.round(F.col(score), 6))
            .withColumn("threshold_review", F.lit(review)).withColumn("threshold_decline", F.lit(decline)))


def decision_counts(banded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows per decision (optionally per extra key such as an endpoint)."""
    return banded.groupBy(*(by or []), "decision").agg(F.count(F.lit(1)).alias("n"))


def cumulative_histogram(df: DataFrame, score: str = "fraud_score", n: int = HISTOGRAM_BOUNDS) -> DataFrame:
    """For every bound i/n (i = 0..n) and +inf: number of scores <= bound."""
    s = F.col(score)
    k = F.ceil(s * n).cast("int")
    k = F.when((k - 1) / F.lit(float(n)) >= s, k - 1).otherwise(k)     # smallest i with s <= i/n
    k = F.when(k / F.lit(float(n)) < s, k + 1).otherwise(k)
    k = F.when(k > n, F.lit(n + 1)).otherwise(F.greatest(k, F.lit(0)))
    counts = df.where(s.isNotNull()).groupBy(k.alias("i")).agg(F.count(F.lit(1)).alias("c"))
    grid = df.sparkSession.range(0, n + 2).select(F.col("id").cast("int").alias("i"))
    # n + 2 rows: a bounded table, the running sum runs in one small task
    full = grid.join(F.broadcast(counts), "i", "left").fillna(0, subset=["c"])
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return full.select(F.when(F.col("i") <= n, F.col("i") / F.lit(float(n))).otherwise(F.lit(float("inf"))).alias("le"),
                       F.sum("c").over(w).alias("count"))


def portfolio_kpis(df: DataFrame, label: str = "label", score: str = "score", flag_at: float = 0.5) -> DataFrame:
    """Scored rows, their fraud rate, mean score, share flagged at ``flag_at``."""
    return df.where(F.col(score).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("fraud_rate"), F.avg(score).alias("mean_score"),
                  F.avg((F.col(score) >= F.lit(flag_at)).cast("int")).alias("flag_rate"))


def score_histogram(df: DataFrame, label: str = "label", score: str = "score", bins: int = DASHBOARD_BINS) -> DataFrame:
    """Fixed [0, 1] bins of width 1/bins by label; 1.0 falls in the last bin, a missing score in none."""
    b = F.least(F.greatest(F.floor(F.col(score) * bins).cast("int"), F.lit(0)), F.lit(bins - 1))
    return df.where(F.col(score).isNotNull()).groupBy(b.alias("bin"), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def decile_rates(df: DataFrame, label: str = "label", score: str = "score", q: int = 10) -> DataFrame:
    """Quantile bucket of the score (duplicate edges dropped) + 1 -> mean label."""
    edges = qcut_edges(quantiles(df, [score], [i / q for i in range(q + 1)])[score])
    return (df.withColumn("decile", qcut_label(score, edges) + 1).where(F.col("decile").isNotNull())
            .groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("fraud_rate")))


def reason_table(scored: DataFrame, reasons_col: str = "reason_codes", key: str = "id") -> DataFrame:
    """Reason codes exploded, ordered by absolute contribution within a request."""
    return (scored.select(key, F.posexplode(reasons_col).alias("rank", "r"))
            .select(key, (F.col("rank") + 1).alias("rank"), "r.feature", "r.value", "r.contribution", "r.direction"))
