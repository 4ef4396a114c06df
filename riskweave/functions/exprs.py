"""Null-safe column expressions used across operators.

Spark 4 runs in ANSI mode: ``/ 0``, bad casts and bad dates raise. pandas
instead yields NaN/NULL. These helpers keep pandas' "missing in, missing out"
semantics with native expressions (codegen, no Python).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL when den is 0 or NULL (pandas ``replace(0, nan)``)."""
    d = col(den)
    return F.try_divide(col(num), F.when(d != 0, d))


def nan_to_null(c: str | Column) -> Column:
    """NaN is a value in Spark (greater than everything); make it NULL."""
    x = col(c)
    return F.when(~F.isnan(x), x)


def to_double(c: str | Column) -> Column:
    """Lenient numeric coercion (``pd.to_numeric(errors='coerce')``), NaN -> NULL."""
    return nan_to_null((F.trim(col(c).cast("string"))).try_cast("double"))


def clip(c: str | Column, lo: float | None, hi: float | None) -> Column:
    """Clip keeping NULL as NULL (Spark's least/greatest would skip NULLs)."""
    x = col(c)
    out = x
    if lo is not None:
        out = F.when(out < F.lit(float(lo)), F.lit(float(lo))).otherwise(out)
    if hi is not None:
        out = F.when(out > F.lit(float(hi)), F.lit(float(hi))).otherwise(out)
    return F.when(x.isNotNull(), out)


def flag(pred: Column) -> Column:
    """Boolean predicate -> 0/1 int, NULL -> 0 (pandas compares NaN as False)."""
    return F.coalesce(pred, F.lit(False)).cast("int")


def null_safe_sum(cols: list[str | Column]) -> Column:
    """Horizontal sum with NULL as 0 (``fillna(0).sum(axis=1)``)."""
    return reduce(lambda a, b: a + b, [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in cols])


def strip(c: str | Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def digit_ratio(c: str | Column) -> Column:
    """Share of digit characters; NULL reads as '' and the denominator is at least 1."""
    s = F.coalesce(col(c), F.lit(""))
    return F.length(F.regexp_replace(s, r"[^0-9]", "")) / F.greatest(F.length(s), F.lit(1))
