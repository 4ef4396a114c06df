"""Registered queries: one Spark callable per operator, plus its DuckDB twin.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the operator over the
driver's tables (whole tables, no subsets). ``ORACLE[name]`` is independent SQL
text for DuckDB over the same Parquet views; it is absent for operators whose
result is only checked by invariants (models, streaming, iterative fits).

Doubles are rounded to 6 decimals at the output of every registered query, in
both engines, so the value hashes compare engine-independent numbers.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..sources.applications import APPLICATIONS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Round every double column (output presentation only)."""
    return df.select(*[
        F.round(F.col(f.name), decimals).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
        else F.col(f.name) for f in df.schema.fields])


def with_apps(body: str) -> str:
    """Prefix oracle SQL with the ``applications`` view as a common table expression."""
    return "WITH applications AS (" + APPLICATIONS_SQL + ")" + body
