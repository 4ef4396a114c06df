"""Weight-of-evidence and smoothed target encoding.

Fit: the categorical columns are unpivoted to (column, value, y) and reduced
by ONE grouped aggregation for all columns (partial aggregation map-side, so a
hot value costs one row per task, not one task). Class totals are a scalar
aggregate. The fitted lookup is a small table ``(column, value, enc)``.

Transform: one left join per encoded column. Each lookup side is broadcast
only when its measured row count is under the bound; a high-cardinality
lookup falls back to a shuffle join (AQE may still broadcast or split skew).
NULL category -> '__NA__'; unknown value -> the fallback (0 for WoE, the
global mean for target encoding).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .joins import sized_broadcast

NA = "__NA__"


def _long(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                      F.coalesce(F.col(c).cast("string"), F.lit(NA)).alias("value"))
                             for c in cols])).alias("e")
    return df.select(F.col(y).cast("double").alias("_y"), kv).select("e.column", "e.value", "_y")


def category_stats(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """(column, value, n, n_pos) for every category of every column (one shuffle)."""
    return (_long(df, cols, y).groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("n_pos")))


@dataclass
class WoEModel:
    cols: list[str]
    table: DataFrame                 # column, value, woe
    iv: DataFrame                    # column, iv
    unknown_value: float = 0.0

    def transform(self, df: DataFrame, broadcast_max_rows: int = 1_000_000) -> DataFrame:
        """``{c}_woe`` per column, unknown -> ``unknown_value``."""
        return _apply(df, self.table, self.cols, "woe", "_woe", F.lit(self.unknown_value), broadcast_max_rows)


@dataclass
class TargetModel:
    cols: list[str]
    table: DataFrame                 # column, value, te
    global_mean: float = 0.0

    def transform(self, df: DataFrame, broadcast_max_rows: int = 1_000_000) -> DataFrame:
        """``{c}_te`` per column, unknown -> the global mean."""
        return _apply(df, self.table, self.cols, "te", "_te", F.lit(self.global_mean), broadcast_max_rows)


def _apply(df, table, cols, enc, suffix, fallback, max_rows):
    # the fitted table is checkpointed: measure it once; every per-column slice is smaller
    small = table.count() <= max_rows
    out = df
    for c in cols:
        look = table.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"),
                                                        F.col(enc).alias(f"{c}{suffix}"))
        look = F.broadcast(look) if small else sized_broadcast(look, max_rows)
        key = F.coalesce(F.col(c).cast("string"), F.lit(NA)) if c in df.columns else F.lit(NA)
        out = (out.withColumn(f"_k_{c}", key)
               .join(look, F.col(f"_k_{c}") == F.col(f"_v_{c}"), "left")
               .withColumn(f"{c}{suffix}", F.coalesce(F.col(f"{c}{suffix}"), fallback))
               .drop(f"_k_{c}", f"_v_{c}"))
    return out


def fit_woe(df: DataFrame, cols: Sequence[str], y: str, smoothing: float = 0.5) -> WoEModel:
    """WoE per (column, value) and information value per column."""
    cols = [c for c in cols if c in df.columns]
    ensure_checkpoint_dir(df.sparkSession)
    tot = df.agg(F.sum(F.col(y).cast("double")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    bad_total = (tot["b"] or 0.0) + smoothing
    good_total = (tot["n"] - (tot["b"] or 0.0)) + smoothing
    st = category_stats(df, cols, y)
    bad = F.col("n_pos") + F.lit(smoothing)
    good = F.col("n") - F.col("n_pos") + F.lit(smoothing)
    woe = F.log((good / F.lit(good_total)) / (bad / F.lit(bad_total)))
    table = st.select("column", "value", woe.alias("woe"),
                      ((good / F.lit(good_total) - bad / F.lit(bad_total)) * woe).alias("iv_part"))
    table = table.checkpoint(eager=True)   # fitted state: independent of the training lineage
    iv = table.groupBy("column").agg(F.sum("iv_part").alias("iv"))
    return WoEModel(cols, table.select("column", "value", "woe"), iv)


def fit_target(df: DataFrame, cols: Sequence[str], y: str, smoothing: float = 20.0) -> TargetModel:
    """(sum + global_mean * s) / (count + s) per (column, value)."""
    cols = [c for c in cols if c in df.columns]
    ensure_checkpoint_dir(df.sparkSession)
    gm = df.agg(F.avg(F.col(y).cast("double")).alias("m")).first()["m"] or 0.0
    st = category_stats(df, cols, y)
    te = (F.col("n_pos") + F.lit(gm * smoothing)) / (F.col("n") + F.lit(smoothing))
    table = st.select("column", "value", te.alias("te")).checkpoint(eager=True)
    return TargetModel(cols, table, gm)


def fit_encoders(df: DataFrame, woe_cols: Sequence[str], te_cols: Sequence[str], y: str,
                 woe_smoothing: float = 0.5, te_smoothing: float = 20.0) -> tuple[WoEModel | None, TargetModel | None]:
    """F1 + F4 from one pass: class totals and the (column, value) statistics of all
    encoded columns come from a single aggregation each; both lookups derive from them."""
    woe_cols = [c for c in woe_cols if c in df.columns]
    te_cols = [c for c in te_cols if c in df.columns]
    if not woe_cols and not te_cols:
        return None, None
    ensure_checkpoint_dir(df.sparkSession)
    tot = df.agg(F.sum(F.col(y).cast("double")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    pos, n = (tot["b"] or 0.0), tot["n"]
    st = category_stats(df, woe_cols + te_cols, y).checkpoint(eager=True)
    woe = te = None
    if woe_cols:
        bad_total, good_total = pos + woe_smoothing, (n - pos) + woe_smoothing
        bad = F.col("n_pos") + F.lit(woe_smoothing)
        good = F.col("n") - F.col("n_pos") + F.lit(woe_smoothing)
        w = F.log((good / F.lit(good_total)) / (bad / F.lit(bad_total)))
        table = st.where(F.col("column").isin(woe_cols)).select(
            "column", "value", w.alias("woe"), ((good / F.lit(good_total) - bad / F.lit(bad_total)) * w).alias("iv_part"))
        iv = table.groupBy("column").agg(F.sum("iv_part").alias("iv"))
        woe = WoEModel(woe_cols, table.select("column", "value", "woe"), iv)
    if te_cols:
        gm = pos / n if n else 0.0
        t = (F.col("n_pos") + F.lit(gm * te_smoothing)) / (F.col("n") + F.lit(te_smoothing))
        te = TargetModel(te_cols, st.where(F.col("column").isin(te_cols)).select("column", "value", t.alias("te")), gm)
    return woe, te
