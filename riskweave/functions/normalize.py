"""Parsing raw application strings into typed columns.

All are native Spark expressions (no Python per value), applied only when the
input column is present and still textual, as the loader does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .exprs import col, nan_to_null, safe_div, strip

# Columns parsed by each rule (same as the reference loader).
PERCENT_COLUMNS = ("int_rate", "revol_util")
DATE_COLUMNS = ("issue_d", "last_pymnt_d", "earliest_cr_line")
MONTH_YEAR_FORMAT = "MMM-yyyy"


def parse_percent(c: str | Column) -> Column:
    """N1: '13.5%' -> 13.5; trailing '%' signs stripped; 'nan', '' and junk -> NULL."""
    s = F.regexp_replace(strip(col(c)), r"%+$", "")
    return nan_to_null((strip(s)).try_cast("double"))


def parse_term(c: str | Column) -> Column:
    """First run of digits as double (' 36 months' -> 36.0), none -> NULL."""
    return (F.regexp_extract(col(c), r"(\d+)", 1)).try_cast("double")


def parse_month_year(c: str | Column) -> Column:
    """N3: 'Dec-2015' (month name case-insensitive) -> 2015-12-01, invalid -> NULL."""
    return F.try_to_date(strip(col(c)), MONTH_YEAR_FORMAT)


def parse_emp_length(c: str | Column) -> Column:
    """N4: '< 1 year' -> 0, anything containing '10' -> 10, else the digits joined.

    The tests run in that order, so '< 10 years' is 0 and '10+ years' is 10.
    """
    s = F.lower(strip(col(c).cast("string")))
    digits = F.regexp_replace(s, r"[^0-9]", "")
    return (F.when(col(c).isNull(), F.lit(None).cast("double"))
            .when(F.instr(s, "<") > 0, F.lit(0.0))
            .when(F.instr(s, "10") > 0, F.lit(10.0))
            .when(digits != "", digits.cast("double")))


def parse_request_date(c: str | Column, as_of: str) -> Column:
    """Request date, invalid or missing -> the explicit ``as_of`` date.

    ``as_of`` is a parameter (not ``current_date()``) so reruns are deterministic.
    """
    return F.coalesce(F.try_to_date(col(c).cast("string")), F.to_date(F.lit(as_of)))


def installment(principal: str | Column, annual_rate_pct: str | Column, n_months: str | Column) -> Column:
    """Amortised monthly payment P*r/(1-(1+r)^-n), r = rate/1200, rounded to 2.

    r = 0 (or NULL) gives NULL instead of a division by zero.
    """
    r = col(annual_rate_pct) / F.lit(1200.0)
    den = F.lit(1.0) - F.pow(F.lit(1.0) + r, -col(n_months))
    return F.round(safe_div(col(principal) * r, den), 2)


def normalise(df: DataFrame) -> DataFrame:
    """N1-N5 over a raw frame: parse the known columns, strip every other string.

    Columns not present are skipped; NULL strings stay NULL (stated difference:
    the pandas loader writes the literal 'nan').
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name, dtype in fields.items():
        textual = isinstance(dtype, StringType)
        if name in PERCENT_COLUMNS and textual:
            out.append(parse_percent(name).alias(name))
        elif name == "term" and textual:
            out.append(parse_term(name).alias(name))
        elif name in DATE_COLUMNS:
            out.append((parse_month_year(name) if textual else F.to_date(name)).alias(name))
        elif name == "emp_length":
            out.append(parse_emp_length(name).alias(name))
        elif textual:
            out.append(strip(name).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
