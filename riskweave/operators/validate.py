"""V1-V3: rule-based validation with a collect-all failure report.

Rules are data (column, check, argument, nullable). All rules of a table are
evaluated in one projection: every row yields an array of the violations it
has, the NULL entries are filtered out and the rest exploded. One scan, no
shuffle; the summary is a partial (map-side) aggregation by (column, check).

Uniqueness (V2) is the only check that needs a shuffle: ``groupBy(key)``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType


@dataclass(frozen=True)
class Rule:
    column: str
    check: str          # "ge", "le", "isin", "not_null", "integer", "type_double", "required"
    arg: Any = None


# The table contract (column ranges and enumerations).
GRADES = ("A", "B", "C", "D", "E", "F", "G")
LOAN_RULES: tuple[Rule, ...] = (
    Rule("id", "not_null"),
    Rule("loan_amnt", "ge", 500), Rule("loan_amnt", "le", 50000),
    Rule("term", "isin", (36.0, 60.0)),
    Rule("int_rate", "ge", 0), Rule("int_rate", "le", 40),
    Rule("installment", "ge", 0),
    Rule("grade", "isin", GRADES),
    Rule("annual_inc", "ge", 0), Rule("annual_inc", "le", 10000000),
    Rule("dti", "ge", -1), Rule("dti", "le", 999),
    Rule("delinq_2yrs", "ge", 0), Rule("delinq_2yrs", "le", 100),
    Rule("open_acc", "ge", 0), Rule("open_acc", "le", 200),
    Rule("revol_bal", "ge", 0),
    Rule("revol_util", "ge", 0), Rule("revol_util", "le", 300),
    Rule("pub_rec", "ge", 0),
)

# The scoring-request contract; required fields, enumerations,
# ranges, integer fields and the defaults of optional fields.
HOME_OWNERSHIP = ("RENT", "MORTGAGE", "OWN", "OTHER", "ANY", "NONE")
VERIFICATION = ("Verified", "Source Verified", "Not Verified")
REQUEST_REQUIRED = ("loan_amnt", "term", "int_rate", "installment", "grade", "sub_grade", "annual_inc",
                    "purpose", "zip_code", "addr_state", "dti")
REQUEST_DEFAULTS = {
    "home_ownership": "RENT", "verification_status": "Not Verified",
    "delinq_2yrs": 0.0, "inq_last_6mths": 0.0, "open_acc": 0.0, "pub_rec": 0.0, "revol_bal": 0.0,
    "revol_util": 0.0, "total_acc": 0.0, "mort_acc": 0.0, "pub_rec_bankruptcies": 0.0,
}
REQUEST_OPTIONAL = ("id", "emp_title", "emp_length", "title", "earliest_cr_line", "issue_d")
REQUEST_INTEGER = ("delinq_2yrs", "inq_last_6mths", "open_acc", "pub_rec", "total_acc", "mort_acc",
                   "pub_rec_bankruptcies")
REQUEST_RULES: tuple[Rule, ...] = (
    Rule("loan_amnt", "ge", 500), Rule("loan_amnt", "le", 50000),
    Rule("term", "isin", (36.0, 60.0)),
    Rule("int_rate", "ge", 0), Rule("int_rate", "le", 40),
    Rule("installment", "ge", 0),
    Rule("grade", "isin", GRADES),
    Rule("emp_length", "ge", 0), Rule("emp_length", "le", 10),
    Rule("home_ownership", "isin", HOME_OWNERSHIP),
    Rule("annual_inc", "ge", 0),
    Rule("verification_status", "isin", VERIFICATION),
    Rule("dti", "ge", -1), Rule("dti", "le", 999),
    *[Rule(c, "ge", 0) for c in REQUEST_INTEGER],
    *[Rule(c, "integer") for c in REQUEST_INTEGER],
    Rule("revol_bal", "ge", 0), Rule("revol_util", "ge", 0),
)

VIOLATION_FIELDS = "struct<column:string,check:string,num_value:double,str_value:string>"


def _violated(df: DataFrame, r: Rule) -> Column | None:
    """Predicate that is true when row violates ``r`` (NULL passes range checks)."""
    if r.column not in df.columns:
        return None
    c = F.col(r.column)
    if r.check == "not_null" or r.check == "required":
        return c.isNull()
    # text in a numeric column: a failed conversion is its own violation (type_double), the range checks skip it
    number = c.cast("string").try_cast("double") if isinstance(df.schema[r.column].dataType, StringType) else c
    if r.check == "ge":
        return F.coalesce(number < F.lit(r.arg), F.lit(False))
    if r.check == "le":
        return F.coalesce(number > F.lit(r.arg), F.lit(False))
    if r.check == "isin":
        return F.coalesce(~(c if isinstance(r.arg[0], str) else number).isin(*r.arg), F.lit(False))
    if r.check == "integer":
        return F.coalesce(number != F.floor(number), F.lit(False))
    if r.check == "type_double":
        if isinstance(df.schema[r.column].dataType, NumericType):
            return F.lit(False)
        return c.isNotNull() & c.cast("string").try_cast("double").isNull()
    raise ValueError(f"unknown check {r.check}")


def _type_rules(rules: Sequence[Rule]) -> tuple[Rule, ...]:
    """A conversion check for every column that has a numeric one."""
    numeric = [r.column for r in rules if r.check in ("ge", "le", "integer")
               or (r.check == "isin" and not isinstance(r.arg[0], str))]
    return tuple(Rule(c, "type_double") for c in dict.fromkeys(numeric))


def _entry(df: DataFrame, r: Rule, pred: Column) -> Column:
    dtype = df.schema[r.column].dataType
    num = F.col(r.column).cast("double") if isinstance(dtype, NumericType) else F.lit(None).cast("double")
    txt = F.col(r.column) if isinstance(dtype, StringType) else F.lit(None).cast("string")
    return F.when(pred, F.struct(F.lit(r.column).alias("column"), F.lit(r.check).alias("check"),
                                 num.alias("num_value"), txt.alias("str_value")))


def violations_column(df: DataFrame, rules: Sequence[Rule]) -> Column:
    """array<struct<column, check, num_value, str_value>> of the rules a row breaks."""
    entries = []
    for r in (*rules, *_type_rules(rules)):
        pred = _violated(df, r)
        if pred is not None:
            entries.append(_entry(df, r, pred))
    if not entries:
        return F.array().cast(f"array<{VIOLATION_FIELDS}>")
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


def validate(df: DataFrame, rules: Sequence[Rule] = LOAN_RULES, key: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """V1: one row per (row key, violated rule): key, ``keep``, column, check, num_value, str_value."""
    return (df.select(F.col(key), *keep, F.explode(violations_column(df, rules)).alias("v"))
            .select(key, *keep, "v.column", "v.check", "v.num_value", "v.str_value"))


def validation_report(df: DataFrame, rules: Sequence[Rule] = LOAN_RULES, key: str = "id") -> DataFrame:
    """V1 and V2 in one report: rule violations, and one ``unique`` failure per row whose key occurs more than once."""
    again = duplicate_keys(df.select(key), key).select(F.col(key).alias("_key"))
    repeated = df.select(key).join(again, F.col(key).eqNullSafe(F.col("_key"))).select(
        key, F.lit(key).alias("column"), F.lit("unique").alias("check"),
        (F.col(key).cast("double") if isinstance(df.schema[key].dataType, NumericType)
         else F.lit(None).cast("double")).alias("num_value"),
        (F.col(key) if isinstance(df.schema[key].dataType, StringType) else F.lit(None).cast("string")).alias("str_value"))
    return validate(df, rules, key).unionByName(repeated)


def violation_summary(violations: DataFrame) -> DataFrame:
    """V1 summary: number of failures per (column, check)."""
    return violations.groupBy("column", "check").agg(F.count(F.lit(1)).alias("n_failures"))


def duplicate_keys(df: DataFrame, key: str = "id") -> DataFrame:
    """V2: keys that occur more than once, with their count (partial aggregation first)."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def request_view(df: DataFrame) -> DataFrame:
    """V3 coercion: keep the contract's fields only (extra fields dropped), apply defaults."""
    cols = []
    for c in (*REQUEST_OPTIONAL, *REQUEST_REQUIRED, *REQUEST_DEFAULTS):
        if c in REQUEST_DEFAULTS:
            default = F.lit(REQUEST_DEFAULTS[c])
            cols.append((F.coalesce(F.col(c), default) if c in df.columns else default).alias(c))
        elif c in df.columns:
            cols.append(F.col(c))
        else:
            cols.append(F.lit(None).cast("string" if c in ("sub_grade", "emp_title", "title", "purpose",
                                                           "zip_code", "addr_state", "grade") else "double")
                        .alias(c))
    return df.select(*cols)


def request_rules() -> tuple[Rule, ...]:
    return tuple(Rule(c, "required") for c in REQUEST_REQUIRED) + REQUEST_RULES


def validate_requests(df: DataFrame, key: str = "id", whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """V3: (accepted rows with defaults applied, violations of the quarantined rows).

    With ``whole`` a violation also carries the request as JSON (``request``), so one without a key can be traced.

    The quarantine side is the exploded long form (key, column, check, ...):
    rows without violations explode to nothing, so no filter on the array is
    needed there. (A filter on the array size combined with its explode makes
    the optimizer push the whole rule array through the upstream joins, where
    constraint inference grows very large.)
    """
    req = request_view(df)
    rules = request_rules()
    good = req.where(F.size(violations_column(req, rules)) == 0)
    if not whole:
        return good, validate(req, rules, key)
    return good, validate(req.withColumn("request", F.to_json(F.struct(*req.columns))), rules, key, ["request"])
