"""Time-ordered and stratified splits, fold assignment, leakage guard.

Splits are a ``split`` string column on one frame, never three copies.

Cut points by row count are found with G1 order statistics on the narrow
ordering key only: the few boundary keys are collected (one per cut), and the
split becomes a projection comparing each row's key with them. The full rows
are never sorted or shuffled for a split.

Ordering keys are compared as structs, whose ordering is lexicographic; a
leading NULL flag puts NULL dates last, as a stable sort of pandas does.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import ranked_positions, rows_at

# Columns a model must never see (labels, rules, outcomes).
LEAKAGE_COLUMNS = ("is_fraud", "rule_fpd", "rule_income_anomaly", "rule_debt_inconsist", "rule_address_ring",
                   "n_anomalies", "loan_status", "last_pymnt_d")


def _time_key(date_col: str, key: str) -> list[Column]:
    return [F.col(date_col).isNull().cast("int").alias("_null"),
            F.coalesce(F.col(date_col), F.to_date(F.lit("0001-01-01"))).alias("_d"),
            F.col(key).alias("_k")]


def time_split(df: DataFrame, date_col: str = "issue_d", val_size: float = 0.15, test_size: float = 0.15,
               key: str = "id") -> DataFrame:
    """Order by (date NULLS LAST, key); rows [0, v) train, [v, t) val, [t, n) test,
    v = int(n * (1 - test - val)), t = int(n * (1 - test)). Exact row counts."""
    if date_col not in df.columns:
        raise ValueError(f"time_split needs the column {date_col!r}; the frame has {sorted(df.columns)}")
    narrow = df.select(*_time_key(date_col, key))
    n, fetch = ranked_positions(narrow, ["_null", "_d", "_k"])     # one sort gives n and the cut rows
    test_start = int(n * (1 - test_size))
    val_start = int(n * (1 - test_size - val_size))
    found = fetch([p for p in (val_start, test_start) if p < n])
    row_key = F.struct(*_time_key(date_col, key))

    def at_or_after(pos: int) -> Column:
        if pos >= n:
            return F.lit(False)
        b = found[pos]
        return row_key >= F.struct(F.lit(b["_null"]).alias("_null"), F.lit(b["_d"]).alias("_d"),
                                   F.lit(b["_k"]).alias("_k"))

    split = (F.when(at_or_after(test_start), "test").when(at_or_after(val_start), "val").otherwise("train"))
    return df.withColumn("split", split)


def split_spans(split_df: DataFrame, date_col: str = "issue_d") -> DataFrame:
    """Rows, first and last date per split."""
    return split_df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min(date_col).alias("min_date"),
                                         F.max(date_col).alias("max_date"))


def _shuffle_key(key: str, seed: int) -> Column:
    """A seeded order that does not depend on the engine: md5 of the key and the seed."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def _class_boundaries(df: DataFrame, target: str, seed: int, key: str, fractions: Sequence[float]):
    """Per class, the shuffled-order keys at the cumulative fractions (collected, a few rows)."""
    shuffled = df.select(F.col(target).alias("_y"), _shuffle_key(key, seed).alias("_h"),
                         F.col(key).alias("_k"))
    counts = {r["_y"]: r["n"] for r in shuffled.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted(counts, key=lambda v: (v is None, v))
    start, acc = {}, 0
    for c in classes:
        start[c] = acc
        acc += counts[c]
    wanted = {}
    for c in classes:
        for j, fr in enumerate(fractions):
            pos = int(math.ceil(counts[c] * fr))
            if pos < counts[c]:
                wanted[(c, j)] = start[c] + pos
    got = {r["_gidx"]: r for r in rows_at(shuffled, ["_y", "_h", "_k"], wanted.values())}
    return classes, {cj: got[p] for cj, p in wanted.items()}


def _bucket_expr(df: DataFrame, target: str, seed: int, key: str, classes, bounds, n_cuts: int) -> Column:
    """Number of class boundaries at or before the row in the shuffled order."""
    row = F.struct(_shuffle_key(key, seed).alias("_h"), F.col(key).alias("_k"))
    expr = F.lit(0)
    for c in classes:
        passed = F.lit(0)
        for j in range(n_cuts):
            b = bounds.get((c, j))
            if b is not None:
                passed = passed + (row >= F.struct(F.lit(b["_h"]).alias("_h"), F.lit(b["_k"]).alias("_k"))).cast("int")
        cond = F.col(target).isNull() if c is None else (F.col(target) == F.lit(c))
        expr = F.when(cond, passed).otherwise(expr)
    return expr


def stratified_split(df: DataFrame, target: str = "is_fraud", val_size: float = 0.15, test_size: float = 0.15,
                     seed: int = 42, key: str = "id") -> DataFrame:
    """Per class, a seeded shuffle (md5 of key and seed); the first ceil(n_c*test)
    rows are test, the next ceil(n_c*(1-test)*val/(1-test)) val, the rest train.

    Class shares are kept in every split. Ranks inside a class come from one
    range sort over (class, hash, key); a window partitioned by a two-valued
    class column would run as two tasks.
    """
    rel_val = val_size / (1 - test_size)
    f_test = test_size
    f_val = test_size + (1 - test_size) * rel_val
    classes, bounds = _class_boundaries(df, target, seed, key, [f_test, f_val])
    b = _bucket_expr(df, target, seed, key, classes, bounds, 2)
    return df.withColumn("split", F.when(b == 0, "test").when(b == 1, "val").otherwise("train"))


def stratified_folds(df: DataFrame, k: int = 3, target: str = "is_fraud", seed: int = 42,
                     key: str = "id", fold_col: str = "fold") -> DataFrame:
    """Stratified, shuffled, seeded K-fold labels 0..k-1 (each class cut into k
    contiguous runs of its shuffled order, so fold sizes per class differ by at most 1)."""
    classes, bounds = _class_boundaries(df, target, seed, key, [j / k for j in range(1, k)])
    return df.withColumn(fold_col, _bucket_expr(df, target, seed, key, classes, bounds, k - 1))


def drop_leakage(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """P5: drop label, rule and outcome columns (the id stays as a pass-through key)."""
    return df.drop(*[c for c in (*LEAKAGE_COLUMNS, *extra) if c in df.columns])
