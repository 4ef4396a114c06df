"""Behavioural features, one projection over the application table.

Everything is a native expression except the decile edges of B5, which are
exact quantiles computed once for both columns (G1 order statistics) and then
inlined as literals: the label is a sum of comparisons, no join, no UDF.
A feature whose input columns are missing is skipped.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import digit_ratio, flag, null_safe_sum, safe_div
from .ordering import quantiles

DECILES = [i / 10 for i in range(11)]
# Columns counted as negative credit events.
NEGATIVE_EVENT_COLUMNS = ("delinq_2yrs", "pub_rec", "pub_rec_bankruptcies")
BUCKET_COLUMNS = {"income_bucket": "annual_inc", "loan_bucket": "loan_amnt"}


def qcut_edges(edges: Sequence[float | None]) -> list[float]:
    """Distinct sorted bin edges (duplicates dropped, as qcut does)."""
    return sorted({e for e in edges if e is not None})


def qcut_label(x: str | Column, edges: Sequence[float]) -> Column:
    """B5 label: right-closed bins (e_i, e_i+1], the first also closed on the left.

    label = #(edges < x) - 1, clamped to [0, bins - 1]; NULL input stays NULL;
    fewer than two distinct edges (constant column) -> NULL for every row.
    """
    c = F.col(x) if isinstance(x, str) else x
    if len(edges) < 2:
        return F.lit(None).cast("int")
    below = reduce(lambda a, b: a + b, [(c > F.lit(float(e))).cast("int") for e in edges])
    label = F.least(F.greatest(below - 1, F.lit(0)), F.lit(len(edges) - 2))
    return F.when(c.isNotNull(), label)


def bucket_edges(df: DataFrame, method: str = "exact") -> dict[str, list[float]]:
    """Decile edges of the bucketed columns present in ``df`` (one sort for all)."""
    present = {k: v for k, v in BUCKET_COLUMNS.items() if v in df.columns}
    if not present:
        return {}
    q = quantiles(df, list(present.values()), DECILES, method=method)
    return {k: qcut_edges(q[v]) for k, v in present.items()}


def build_behavioral_features(df: DataFrame, edges: dict[str, list[float]] | None = None,
                              quantile_method: str = "exact") -> DataFrame:
    """B1-B7 over ``df``; bucket edges are fitted on ``df`` itself unless given."""
    cols = set(df.columns)
    new: list[Column] = []
    if {"loan_amnt", "annual_inc"} <= cols:
        new.append(safe_div("loan_amnt", "annual_inc").alias("loan_to_income"))
    if {"installment", "annual_inc"} <= cols:
        new.append(safe_div(F.col("installment") * 12, "annual_inc").alias("installment_to_income"))
    if {"revol_bal", "annual_inc"} <= cols:
        new.append(safe_div("revol_bal", "annual_inc").alias("revol_bal_to_income"))
    if {"earliest_cr_line", "issue_d"} <= cols:
        years = F.datediff("issue_d", "earliest_cr_line") / F.lit(365.25)
        new.append(F.when(years.isNotNull(), F.greatest(years, F.lit(0.0))).alias("credit_history_years"))
    if {"open_acc", "total_acc"} <= cols:
        new.append(safe_div("open_acc", "total_acc").alias("pct_open_acc"))
    neg = [c for c in NEGATIVE_EVENT_COLUMNS if c in cols]
    if neg:
        new.append(null_safe_sum(neg).alias("n_negative_events"))
    if "dti" in cols:
        new.append(flag(F.col("dti") > 35).alias("flag_high_dti"))
    if "emp_length" in cols:
        new.append((F.coalesce(F.col("emp_length"), F.lit(0.0)) == 0).cast("int").alias("flag_no_employment"))
    if edges is None:
        edges = bucket_edges(df, quantile_method)
    for out, src in BUCKET_COLUMNS.items():
        if src in cols:
            new.append(qcut_label(src, edges.get(out, [])).alias(out))
    if "issue_d" in cols:
        new += [F.month("issue_d").alias("app_month"), F.quarter("issue_d").alias("app_quarter"),
                F.year("issue_d").alias("app_year")]
    for c in ("title", "emp_title"):
        if c in cols:
            new += [F.length(F.coalesce(F.col(c), F.lit(""))).alias(f"{c}_len"),
                    digit_ratio(c).alias(f"{c}_digit_ratio")]
    return df.select("*", *new)
