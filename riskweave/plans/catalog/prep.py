"""Registered queries: sources (IO1-IO5), parsing (N1-N7), validation (V1-V3), behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import normalize as N
from ...functions.exprs import to_double
from ...operators import behavior as B
from ...operators import validate as V
from ...sources import io as IO
from ...sources.applications import applications, raw_applications
from ...sources.tables import table
from ..registry import register, rounded, with_apps

# ---------------------------------------------------------------- DuckDB twins

# raw strings rendered by DuckDB itself
_RAW = """
, raw AS (
  SELECT id,
    strftime(issue_d, '%b-%Y') AS issue_d_raw,
    lower(strftime(earliest_cr_line, '%b-%Y')) AS ecl_raw,
    strftime(last_pymnt_d, '%b-%Y') AS lpd_raw,
    ' ' || CAST(CAST(term AS INTEGER) AS VARCHAR) || ' months' AS term_raw,
    CAST(int_rate AS VARCHAR) || '%' AS int_rate_raw,
    CASE WHEN revol_util IS NULL THEN 'nan' ELSE ' ' || CAST(revol_util AS VARCHAR) || '%' END AS revol_util_raw,
    CASE WHEN emp_length IS NULL THEN NULL WHEN emp_length = 0 THEN '< 1 year'
         WHEN emp_length >= 10 THEN '10+ years' WHEN emp_length = 1 THEN '1 year'
         ELSE CAST(CAST(emp_length AS INTEGER) AS VARCHAR) || ' years' END AS emp_raw,
    ' ' || grade || ' ' AS grade_raw, emp_title, title
  FROM applications)
"""


def _pct_sql(x: str) -> str:
    s = f"regexp_replace(trim({x}), '%+$', '')"
    return f"CASE WHEN isnan(TRY_CAST(trim({s}) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim({s}) AS DOUBLE) END"


def _emp_sql(x: str) -> str:
    s = f"lower(trim({x}))"
    digits = f"regexp_replace({s}, '[^0-9]', '', 'g')"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN strpos({s}, '<') > 0 THEN 0e0 "
            f"WHEN strpos({s}, '10') > 0 THEN 10e0 "
            f"WHEN {digits} <> '' THEN CAST({digits} AS DOUBLE) END")


def _month_sql(x: str) -> str:
    return f"CAST(try_strptime(trim({x}), '%b-%Y') AS DATE)"


_INSTALLMENT_SQL = "round(loan_amnt * (int_rate / 1200e0) / (1e0 - pow(1e0 + int_rate / 1200e0, -term)), 2)"


def _with_installment(a):
    return a.withColumn("installment", N.installment("loan_amnt", "int_rate", "term"))


# ---------------------------------------------------------------- IO1 / N1-N7

@register("IO1_csv_scan_normalise", with_apps("""
SELECT id, issue_d, term, int_rate, revol_util, emp_length, grade, loan_amnt, annual_inc,
       CAST(date_trunc('month', earliest_cr_line) AS DATE) AS earliest_cr_line,
       CAST(date_trunc('month', last_pymnt_d) AS DATE) AS last_pymnt_d, title
FROM applications"""))
def io1(spark, sf):
    """Raw export -> CSV in the shared scratch folder -> allow-listed scan -> N1-N5."""
    raw = raw_applications(spark, sf).withColumn("member_note", F.lit("not read"))
    path = IO.write_csv(raw, IO.scratch_path(spark, "raw-csv"))
    df = N.normalise(IO.read_raw_csv(spark, path))
    return rounded(df.select(
        F.col("id").cast("long").alias("id"), "issue_d", "term", "int_rate", "revol_util", "emp_length", "grade",
        to_double("loan_amnt").alias("loan_amnt"), to_double("annual_inc").alias("annual_inc"),
        "earliest_cr_line", "last_pymnt_d", "title"))


@register("IO1_quoted_csv_to_typed", with_apps("""
SELECT id, title || ' "quoted", ' || id AS title,
       CASE WHEN id % 31 = 0 THEN NULL ELSE round(loan_amnt, 6) END AS loan_amnt, round(annual_inc, 6) AS annual_inc
FROM applications"""))
def io1_quoted(spark, sf):
    """Quotes and commas inside a field and text in a numeric column, through the CSV file to the typed frame."""
    raw = raw_applications(spark, sf)
    raw = raw.withColumn("title", F.concat("title", F.lit(' "quoted", '), "id")) \
        .withColumn("loan_amnt", F.when(F.col("id").cast("long") % 31 == 0, F.lit("n/a")).otherwise(F.col("loan_amnt")))
    path = IO.write_csv(raw, IO.scratch_path(spark, "quoted-csv"))
    return rounded(IO.typed_applications(N.normalise(IO.read_raw_csv(spark, path))).select(
        "id", "title", "loan_amnt", "annual_inc"))


@register("IO1_csv_rejects", with_apps("""
, k AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'a' WHEN id % 3 = 0 THEN 'c' ELSE 'b' END AS f, grade, zip_code FROM applications)
SELECT id, CASE WHEN f = 'c' THEN 'header' WHEN id % 17 = 0 OR id % 19 = 0 THEN 'fields' ELSE 'accepted' END AS outcome,
       CASE WHEN f <> 'c' AND id % 17 <> 0 AND id % 19 <> 0 THEN zip_code END AS zip_code,
       CASE WHEN f = 'a' AND id % 17 <> 0 AND id % 19 <> 0 THEN grade END AS grade FROM k"""))
def io1_rejects(spark, sf):
    """Three kinds of files in one folder (another column order, a missing column, no id column), with short and long
    lines in each: every line is accepted under its own header or rejected with a reason."""
    a = applications(spark, sf).select("id", "grade", "zip_code")
    ragged = F.when(F.col("id") % 17 == 0, F.lit("")).when(F.col("id") % 19 == 0, F.lit(",x,more"))
    short = F.col("id") % 17 == 0
    kinds = {  # header and fields of a line; the last field is left out of a short line
        "a": ("id,grade,zip_code", F.concat_ws(",", F.col("id").cast("string"), "grade", F.when(~short, F.col("zip_code"))), "id % 2 = 0"),
        "b": ("zip_code,id", F.concat_ws(",", F.when(~short, F.col("zip_code")), F.col("id").cast("string")), "id % 2 <> 0 AND id % 3 <> 0"),
        "c": ("zip_code,grade,note", F.concat_ws(",", "zip_code", "grade", F.col("id").cast("string")), "id % 2 <> 0 AND id % 3 = 0")}
    path = IO.scratch_path(spark, "mixed-csv")
    for name, (header, line, which) in kinds.items():
        # the writer puts the header, which is the column's name, into every file
        lines = a.where(which).select(F.concat(line, F.coalesce(ragged, F.lit(""))).alias("value"))
        parts = 3
        body = lines.repartition(parts).withColumn("part", F.spark_partition_id())
        head = spark.range(parts).select(F.lit(header).alias("value"), F.col("id").cast("int").alias("part"), F.lit(0).alias("at"))
        rows = head.unionByName(body.withColumn("at", F.lit(1))).repartition(parts, "part").sortWithinPartitions("part", "at").drop("at")
        rows.write.partitionBy("part").text(f"{path}/{name}")
    got, rejected = IO.read_csv_with_rejects(spark, f"{path}/*/*", ("id", "zip_code", "grade"))
    number = F.regexp_extract("line", r"(?:^|,)(\d+)(?:,|$)", 1)
    return got.select(F.col("id").cast("long").alias("id"), F.lit("accepted").alias("outcome"), "zip_code", "grade").unionByName(
        rejected.select(number.cast("long").alias("id"), F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("zip_code"),
                        F.lit(None).cast("string").alias("grade")))


@register("V1_V2_report_of_dirty_rows", with_apps("""
, src AS (SELECT id, CASE WHEN id % 31 = 0 THEN 'n/a' ELSE CAST(CAST(loan_amnt AS INTEGER) AS VARCHAR) END AS loan_amnt
          FROM applications UNION ALL SELECT id, '1000' FROM applications WHERE id % 101 = 0)
SELECT id, 'loan_amnt' AS "column", 'ge' AS "check" FROM src WHERE TRY_CAST(loan_amnt AS DOUBLE) < 500
UNION ALL SELECT id, 'loan_amnt', 'le' FROM src WHERE TRY_CAST(loan_amnt AS DOUBLE) > 50000
UNION ALL SELECT id, 'loan_amnt', 'type_double' FROM src WHERE loan_amnt = 'n/a'
UNION ALL SELECT id, 'id', 'unique' FROM src WHERE id % 101 = 0"""))
def v1_dirty(spark, sf):
    """Text in a numeric column and repeated ids are reported, not raised."""
    a = applications(spark, sf).select("id", F.when(F.col("id") % 31 == 0, F.lit("n/a"))
                                       .otherwise(F.round("loan_amnt").cast("int").cast("string")).alias("loan_amnt"))
    extra = applications(spark, sf).where("id % 101 = 0").select("id", F.lit("1000").alias("loan_amnt"))
    rules = [r for r in V.LOAN_RULES if r.column in ("id", "loan_amnt")]
    return V.validation_report(a.unionByName(extra), rules).select("id", "column", "check")


@register("N1_parse_percent", with_apps(_RAW + f"""
SELECT id, {_pct_sql('int_rate_raw')} AS int_rate, {_pct_sql('revol_util_raw')} AS revol_util FROM raw"""))
def n1(spark, sf):
    r = raw_applications(spark, sf)
    return rounded(r.select(F.col("id").cast("long").alias("id"), N.parse_percent("int_rate").alias("int_rate"),
                            N.parse_percent("revol_util").alias("revol_util")))


@register("N2_parse_term", with_apps(_RAW + """
SELECT id, TRY_CAST(regexp_extract(term_raw, '(\\d+)', 1) AS DOUBLE) AS term FROM raw"""))
def n2(spark, sf):
    r = raw_applications(spark, sf)
    return r.select(F.col("id").cast("long").alias("id"), N.parse_term("term").alias("term"))


@register("N3_parse_month_year", with_apps(_RAW + f"""
SELECT id, {_month_sql('issue_d_raw')} AS issue_d, {_month_sql('ecl_raw')} AS earliest_cr_line,
       {_month_sql('lpd_raw')} AS last_pymnt_d FROM raw"""))
def n3(spark, sf):
    r = raw_applications(spark, sf)
    return r.select(F.col("id").cast("long").alias("id"), N.parse_month_year("issue_d").alias("issue_d"),
                    N.parse_month_year("earliest_cr_line").alias("earliest_cr_line"),
                    N.parse_month_year("last_pymnt_d").alias("last_pymnt_d"))


@register("N4_parse_emp_length", with_apps(_RAW + f"""
SELECT id, emp_raw, {_emp_sql('emp_raw')} AS emp_length FROM raw"""))
def n4(spark, sf):
    r = raw_applications(spark, sf)
    return r.select(F.col("id").cast("long").alias("id"), F.col("emp_length").alias("emp_raw"),
                    N.parse_emp_length("emp_length").alias("emp_length"))


@register("N5_strip_strings", with_apps(_RAW + """
SELECT id, trim(grade_raw) AS grade, trim(emp_title) AS emp_title, trim(title) AS title FROM raw"""))
def n5(spark, sf):
    df = N.normalise(raw_applications(spark, sf))
    return df.select(F.col("id").cast("long").alias("id"), "grade", "emp_title", "title")


@register("N6_request_date", with_apps("""
, req AS (SELECT id, CASE WHEN id % 13 = 0 THEN 'not-a-date' WHEN id % 7 = 0 THEN NULL
                     ELSE strftime(issue_d, '%Y-%m-%d') END AS issue_raw FROM applications)
SELECT id, coalesce(TRY_CAST(issue_raw AS DATE), DATE '2024-01-01') AS issue_d FROM req"""))
def n6(spark, sf):
    a = applications(spark, sf)
    raw = (F.when(F.col("id") % 13 == 0, F.lit("not-a-date")).when(F.col("id") % 7 == 0, F.lit(None))
           .otherwise(F.date_format("issue_d", "yyyy-MM-dd")))
    return a.select("id", N.parse_request_date(raw, "2024-01-01").alias("issue_d"))


@register("N7_installment", with_apps(f"""
SELECT id, {_INSTALLMENT_SQL} AS installment FROM applications"""))
def n7(spark, sf):
    a = applications(spark, sf)
    return rounded(a.select("id", N.installment("loan_amnt", "int_rate", "term").alias("installment")))


# ---------------------------------------------------------------- V1-V3

def _rule_sql(r: V.Rule, numeric: bool) -> str:
    c = r.column
    if r.check in ("not_null", "required"):
        pred = f"{c} IS NULL"
    elif r.check == "ge":
        pred = f"{c} < {float(r.arg)!r}e0".replace(".0e0", "e0")
    elif r.check == "le":
        pred = f"{c} > {float(r.arg)!r}e0".replace(".0e0", "e0")
    elif r.check == "isin":
        vals = ", ".join(f"'{v}'" if isinstance(v, str) else f"{float(v)!r}".replace(".0", "e0") for v in r.arg)
        pred = f"{c} NOT IN ({vals})"
    elif r.check == "integer":
        pred = f"{c} <> floor({c})"
    else:
        raise ValueError(r.check)
    num = f"CAST({c} AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
    txt = "CAST(NULL AS VARCHAR)" if numeric else c
    return (f"SELECT id, '{c}' AS \"column\", '{r.check}' AS \"check\", {num} AS num_value, {txt} AS str_value "
            f"FROM src WHERE coalesce({pred}, false)")


_STRING_COLS = {"grade", "home_ownership", "verification_status", "sub_grade", "purpose", "zip_code", "addr_state",
                "emp_title", "title"}


def _violations_sql(rules, present) -> str:
    return "\nUNION ALL\n".join(_rule_sql(r, r.column not in _STRING_COLS) for r in rules if r.column in present)


_V1_PRESENT = {"id", "loan_amnt", "term", "int_rate", "installment", "grade", "annual_inc", "dti", "delinq_2yrs",
               "open_acc", "revol_bal", "revol_util", "pub_rec"}
_V1_SRC = f", src AS (SELECT *, {_INSTALLMENT_SQL} AS installment FROM applications)\n"
_V1_SQL = _V1_SRC + ", v AS (" + _violations_sql(V.LOAN_RULES, _V1_PRESENT) + ")\n"


@register("V1_validation_violations", with_apps(_V1_SQL + "SELECT * FROM v"))
def v1(spark, sf):
    return rounded(V.validate(_with_installment(applications(spark, sf))))


@register("V1_validation_summary", with_apps(_V1_SQL + """
SELECT "column", "check", count(*) AS n_failures FROM v GROUP BY "column", "check" """))
def v1_summary(spark, sf):
    return V.violation_summary(V.validate(_with_installment(applications(spark, sf))))


@register("V2_duplicate_keys", """
SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1""")
def v2(spark, sf):
    return V.duplicate_keys(table(spark, sf, "lineitem"), "l_orderkey")


@register("V2_unique_application_id", with_apps("""
SELECT id, count(*) AS n FROM applications GROUP BY id HAVING count(*) > 1"""))
def v2_apps(spark, sf):
    return V.duplicate_keys(applications(spark, sf), "id")


def request_rows(spark, sf):
    """Scoring requests built from applications: outcome columns and the segment
    column (not an ownership value) dropped, sub_grade and installment derived."""
    a = _with_installment(applications(spark, sf))
    a = a.withColumn("sub_grade", F.concat(F.col("grade"), (F.col("id") % 5 + 1).cast("string")))
    return a.drop("loan_status", "last_pymnt_d", "home_ownership", "score")


_V3_PRESENT = {"id", "loan_amnt", "term", "int_rate", "installment", "grade", "sub_grade", "emp_length",
               "annual_inc", "purpose", "zip_code", "addr_state", "dti", "delinq_2yrs", "open_acc", "pub_rec",
               "revol_bal", "revol_util", "total_acc", "home_ownership", "verification_status", "inq_last_6mths",
               "mort_acc", "pub_rec_bankruptcies"}
_V3_SRC = f""", src AS (
  SELECT id, loan_amnt, term, int_rate, {_INSTALLMENT_SQL} AS installment, grade,
         grade || CAST(id % 5 + 1 AS VARCHAR) AS sub_grade, emp_length, annual_inc, purpose, zip_code, addr_state,
         dti, coalesce(delinq_2yrs, 0e0) AS delinq_2yrs, coalesce(open_acc, 0e0) AS open_acc,
         coalesce(pub_rec, 0e0) AS pub_rec, coalesce(revol_bal, 0e0) AS revol_bal,
         coalesce(revol_util, 0e0) AS revol_util, coalesce(total_acc, 0e0) AS total_acc,
         'RENT' AS home_ownership, 'Not Verified' AS verification_status, 0e0 AS inq_last_6mths,
         0e0 AS mort_acc, 0e0 AS pub_rec_bankruptcies
  FROM applications)
"""
_V3_SQL = _V3_SRC + ", v AS (" + _violations_sql(V.request_rules(), _V3_PRESENT) + ")\n"


@register("V3_request_violations", with_apps(_V3_SQL + """SELECT id, "column", "check" FROM v"""))
def v3(spark, sf):
    _, bad = V.validate_requests(request_rows(spark, sf))
    return bad.select("id", "column", "check")


@register("V3_request_gate", with_apps(_V3_SQL + """
SELECT CASE WHEN id IN (SELECT id FROM v) THEN 'quarantined' ELSE 'accepted' END AS status, count(*) AS n
FROM src GROUP BY 1"""))
def v3_gate(spark, sf):
    good, bad = V.validate_requests(request_rows(spark, sf))
    quarantined = bad.select("id").distinct()
    return (good.select(F.lit("accepted").alias("status"))
            .unionByName(quarantined.select(F.lit("quarantined").alias("status")))
            .groupBy("status").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- B1-B7

_DEC = "[0e0, 1e-1, 2e-1, 3e-1, 4e-1, 5e-1, 6e-1, 7e-1, 8e-1, 9e-1, 1e0]"


def _bucket_sql(col: str, out: str) -> str:
    return f"""
, q_{out} AS (SELECT unnest(quantile_cont({col}, {_DEC})) AS e FROM applications WHERE {col} IS NOT NULL),
e_{out} AS (SELECT DISTINCT round(e, 6) AS e FROM q_{out}),
m_{out} AS (SELECT count(*) AS m FROM e_{out}),
b_{out} AS (
  SELECT a.id, CASE WHEN a.{col} IS NULL OR (SELECT m FROM m_{out}) < 2 THEN NULL
    ELSE CAST(least(greatest((SELECT count(*) FROM e_{out} WHERE e_{out}.e < a.{col}) - 1, 0),
                    (SELECT m FROM m_{out}) - 2) AS INTEGER) END AS {out}
  FROM applications a)
"""


_BEH_SRC = f", src AS (SELECT *, {_INSTALLMENT_SQL} AS installment FROM applications)\n"


def _beh(spark, sf, with_buckets=False):
    a = _with_installment(applications(spark, sf))
    return B.build_behavioral_features(a, edges=None if with_buckets else {})


@register("B1_safe_ratios", with_apps(_BEH_SRC + """
SELECT id, round(loan_amnt / nullif(annual_inc, 0), 6) AS loan_to_income,
       round(installment * 12 / nullif(annual_inc, 0), 6) AS installment_to_income,
       round(revol_bal / nullif(annual_inc, 0), 6) AS revol_bal_to_income,
       round(open_acc / nullif(total_acc, 0), 6) AS pct_open_acc
FROM src"""))
def b1(spark, sf):
    return rounded(_beh(spark, sf).select("id", "loan_to_income", "installment_to_income", "revol_bal_to_income",
                                          "pct_open_acc"))


@register("B2_credit_history_years", with_apps("""
SELECT id, round(greatest(datediff('day', earliest_cr_line, issue_d) / 365.25e0, 0e0), 6) AS credit_history_years
FROM applications"""))
def b2(spark, sf):
    return rounded(_beh(spark, sf).select("id", "credit_history_years"))


@register("B3_negative_events", with_apps("""
SELECT id, coalesce(delinq_2yrs, 0e0) + coalesce(pub_rec, 0e0) AS n_negative_events FROM applications"""))
def b3(spark, sf):
    return rounded(_beh(spark, sf).select("id", "n_negative_events"))


@register("B4_flags", with_apps("""
SELECT id, CAST(coalesce(dti > 35, false) AS INTEGER) AS flag_high_dti,
       CAST(coalesce(emp_length, 0e0) = 0 AS INTEGER) AS flag_no_employment FROM applications"""))
def b4(spark, sf):
    return _beh(spark, sf).select("id", "flag_high_dti", "flag_no_employment")


@register("B5_quantile_buckets", with_apps(_bucket_sql("annual_inc", "income_bucket")
                                           + _bucket_sql("loan_amnt", "loan_bucket") + """
SELECT id, income_bucket, loan_bucket FROM b_income_bucket JOIN b_loan_bucket USING (id)"""))
def b5(spark, sf):
    return _beh(spark, sf, with_buckets=True).select("id", "income_bucket", "loan_bucket")


@register("B6_date_parts", with_apps("""
SELECT id, CAST(month(issue_d) AS INTEGER) AS app_month, CAST(quarter(issue_d) AS INTEGER) AS app_quarter,
       CAST(year(issue_d) AS INTEGER) AS app_year FROM applications"""))
def b6(spark, sf):
    return _beh(spark, sf).select("id", "app_month", "app_quarter", "app_year")


@register("B7_text_stats", with_apps("""
SELECT id, CAST(length(coalesce(title, '')) AS INTEGER) AS title_len,
  round(length(regexp_replace(coalesce(title, ''), '[^0-9]', '', 'g')) / greatest(length(coalesce(title, '')), 1), 6)
    AS title_digit_ratio,
  CAST(length(coalesce(emp_title, '')) AS INTEGER) AS emp_title_len,
  round(length(regexp_replace(coalesce(emp_title, ''), '[^0-9]', '', 'g'))
        / greatest(length(coalesce(emp_title, '')), 1), 6) AS emp_title_digit_ratio
FROM applications"""))
def b7(spark, sf):
    return rounded(_beh(spark, sf).select("id", "title_len", "title_digit_ratio", "emp_title_len",
                                          "emp_title_digit_ratio"))


# ---------------------------------------------------------------- IO2-IO5

@register("IO2_seeded_sample", with_apps("""
SELECT id, issue_d, round(loan_amnt, 6) AS loan_amnt FROM applications
ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT 1000"""))
def io2(spark, sf):
    """Exactly 1,000 applications (or all when fewer), reproducible for seed 42."""
    a = applications(spark, sf).select("id", "issue_d", "loan_amnt")
    return rounded(IO.seeded_sample(a, 1000, seed=42))


@register("IO3_IO4_prediction_roundtrip", with_apps("""
SELECT id, CAST(CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END AS INTEGER) AS y_true,
       round(score, 6) AS proba FROM applications"""))
def io3(spark, sf):
    a = applications(spark, sf)
    pairs = a.select("id", (F.col("loan_status") == "Charged Off").cast("int").alias("y_true"),
                     F.col("score").alias("proba"))
    path = IO.write_predictions(pairs, IO.scratch_path(spark, "predictions"), fmt="csv")
    return rounded(IO.read_predictions(spark, path, fmt="csv"))


@register("IO5_metric_report", with_apps("""
SELECT 'applications' AS model, metric, value FROM (
  SELECT 'n' AS metric, CAST(count(*) AS DOUBLE) AS value FROM applications
  UNION ALL SELECT 'mean_score', round(avg(score), 6) FROM applications
  UNION ALL SELECT 'mean_loan_amnt', round(avg(loan_amnt), 6) FROM applications)"""))
def io5(spark, sf):
    a = applications(spark, sf)
    wide = a.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("score").alias("mean_score"),
                 F.avg("loan_amnt").alias("mean_loan_amnt"))
    report = IO.metric_rows(wide, "applications")
    path = IO.write_report(report, IO.scratch_path(spark, "report"))
    return rounded(spark.read.schema("model string, metric string, value double").json(path))
