"""Registered queries for the applications view and the label rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import labels as L
from ...sources.applications import applications
from ...sources.scratch import materialise
from ..registry import register, rounded, with_apps

_DEF = "loan_status IN ('Charged Off', 'Default')"

_LABELS_SQL = f"""
, cut AS (SELECT round(quantile_cont(annual_inc, 0.995), 6) AS c FROM applications WHERE annual_inc IS NOT NULL),
rings AS (SELECT zip_code FROM applications WHERE zip_code IS NOT NULL GROUP BY zip_code
          HAVING sum(CASE WHEN {_DEF} THEN 1 ELSE 0 END) >= 25),
lab AS (
  SELECT a.*,
    CAST(CASE WHEN {_DEF} AND (datediff('day', issue_d, last_pymnt_d) IS NULL
              OR datediff('day', issue_d, last_pymnt_d) <= 90) THEN 1 ELSE 0 END AS INTEGER) AS rule_fpd,
    CAST(CASE WHEN annual_inc >= (SELECT c FROM cut) AND coalesce(emp_length, 0) <= 1 THEN 1 ELSE 0 END AS INTEGER)
      AS rule_income_anomaly,
    CAST(CASE WHEN dti > 60 AND annual_inc > 500000 THEN 1 ELSE 0 END AS INTEGER) AS rule_debt_inconsist,
    CAST(CASE WHEN zip_code IN (SELECT zip_code FROM rings) THEN 1 ELSE 0 END AS INTEGER) AS rule_address_ring
  FROM applications a),
labelled AS (
  SELECT *, rule_income_anomaly + rule_debt_inconsist + rule_address_ring AS n_anomalies,
    CAST(CASE WHEN rule_fpd = 1 OR rule_income_anomaly + rule_debt_inconsist + rule_address_ring >= 2
         THEN 1 ELSE 0 END AS INTEGER) AS is_fraud
  FROM lab)
"""

# Shared by other catalog modules: the labelled view as SQL common table expressions.
LABELLED_CTES = _LABELS_SQL


_LABEL_INPUTS = ("id", "loan_status", "issue_d", "last_pymnt_d", "annual_inc", "emp_length", "dti", "zip_code")


def labelled(spark, sf, *columns):
    """Applications with L1-L5, lazily: the flags are a projection over one quantile and the ring zips, so a query
    scans the columns it selects and no others. With ``columns`` these and the label inputs are written
    once, and quantile, rings and projection all read that table instead of the view's joins."""
    a = applications(spark, sf)
    if columns:
        a = materialise(a.select(*dict.fromkeys((*_LABEL_INPUTS, *columns))), "label-inputs")
    return L.build_fraud_labels(a)


@register("FX_applications", with_apps(" SELECT * FROM applications"))
def fx_applications(spark, sf):
    return rounded(applications(spark, sf))


@register("L1_first_payment_default", with_apps(f"""
SELECT id, CAST(CASE WHEN {_DEF} AND (datediff('day', issue_d, last_pymnt_d) IS NULL
       OR datediff('day', issue_d, last_pymnt_d) <= 90) THEN 1 ELSE 0 END AS INTEGER) AS rule_fpd
FROM applications"""))
def l1(spark, sf):
    return L.rule_fpd(applications(spark, sf)).select("id", "rule_fpd")


@register("L2_income_anomaly", with_apps(_LABELS_SQL + """
SELECT id, annual_inc, rule_income_anomaly, (SELECT c FROM cut) AS income_cutoff FROM labelled"""))
def l2(spark, sf):
    a = applications(spark, sf)
    cut = L.income_cutoff(a)
    return rounded(L.rule_income_anomaly(a, cutoff=cut)
                   .select("id", "annual_inc", "rule_income_anomaly", F.lit(cut).alias("income_cutoff")))


@register("L3_debt_inconsistency", with_apps("""
SELECT id, CAST(CASE WHEN dti > 60 AND annual_inc > 500000 THEN 1 ELSE 0 END AS INTEGER) AS rule_debt_inconsist
FROM applications"""))
def l3(spark, sf):
    return L.rule_debt_inconsistency(applications(spark, sf)).select("id", "rule_debt_inconsist")


@register("L4_address_ring", with_apps(_LABELS_SQL + """
SELECT id, zip_code, rule_address_ring FROM labelled"""))
def l4(spark, sf):
    return L.rule_address_ring(applications(spark, sf)).select("id", "zip_code", "rule_address_ring")


@register("L5_fraud_labels", with_apps(_LABELS_SQL + """
SELECT id, rule_fpd, rule_income_anomaly, rule_debt_inconsist, rule_address_ring, n_anomalies, is_fraud
FROM labelled"""))
def l5(spark, sf):
    return labelled(spark, sf, "id").select("id", "rule_fpd", "rule_income_anomaly", "rule_debt_inconsist",
                                      "rule_address_ring", "n_anomalies", "is_fraud")


_L6_SQL = with_apps(_LABELS_SQL + """
SELECT addr_state, count(*) AS n, round(avg(is_fraud), 6) AS fraud_rate, round(avg(rule_fpd), 6) AS fpd_rate,
       round(avg(CASE WHEN n_anomalies >= 2 THEN 1 ELSE 0 END), 6) AS multi_anomaly_rate
FROM labelled GROUP BY addr_state""")


@register("L6_label_summary_by_state", _L6_SQL)
def l6(spark, sf):
    return rounded(L.label_summary(labelled(spark, sf, "addr_state"), by=["addr_state"]))


@register("L6_label_summary", with_apps(_LABELS_SQL + """
SELECT count(*) AS n, round(avg(is_fraud), 6) AS fraud_rate, round(avg(rule_fpd), 6) AS fpd_rate,
       round(avg(CASE WHEN n_anomalies >= 2 THEN 1 ELSE 0 END), 6) AS multi_anomaly_rate
FROM labelled"""))
def l6_total(spark, sf):
    return rounded(L.label_summary(labelled(spark, sf, "id")))
