"""Registered queries: evaluation (E1-E10), scoring reports (S1, S4-S8), drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import drift as D
from ...operators import evaluate as E
from ...operators import scoring as S
from ...operators import split as P
from ...sources.applications import applications
from ...sources.io import scratch_path
from ...sources.scratch import materialise
from ...sources.tables import table
from ...streaming import monitoring as MO
from ..registry import register, rounded, with_apps
from .labels import LABELLED_CTES, labelled
from .windows import _P1_SQL


def _some_scores():
    return F.when(F.col("id") % 97 != 0, F.col("score"))


def pairs(spark, sf):
    """Scored pairs over the labelled applications (label = is_fraud); every 97th application has no score."""
    unknown = labelled(spark, sf, "score").select("id", "is_fraud", _some_scores().alias("score"))
    return materialise(E.scored_pairs(unknown, "is_fraud", "score"), "pairs")


def doc_pairs(spark, sf):
    """Second source: labelled documents, label = toxic, score a function of the length."""
    lab = table(spark, sf, "labels").select("doc_id", "toxic")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    j = lab.join(docs, "doc_id")
    return j.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label"),
                    (F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0))).alias("score"))


_PAIRS = LABELLED_CTES + """, all_pairs AS (SELECT id, is_fraud AS label, CASE WHEN id % 97 <> 0 THEN score END AS score FROM labelled),
pairs AS (SELECT * FROM all_pairs WHERE score IS NOT NULL)
"""
_DOC_PAIRS = """WITH pairs AS (SELECT l.doc_id AS id, CAST(l.toxic AS INTEGER) AS label,
  d.n_chars / (d.n_chars + 2000e0) AS score FROM labels l JOIN documents d USING (doc_id))
"""

_CURVE = """
, t AS (SELECT score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM pairs GROUP BY score),
c AS (SELECT score, pos, neg,
        sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
        sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM t),
tot AS (SELECT sum(pos) AS p_, sum(neg) AS n_ FROM t),
cm AS (SELECT sum(neg * (tp - pos / 2)) / (max(p_) * max(n_)) AS roc_auc,
              sum(pos * tp / (tp + fp)) / max(p_) AS pr_auc,
              greatest(max(tp / p_ - fp / n_), 0e0) AS ks,
              coalesce(max(CASE WHEN fp / n_ <= 5e-2 THEN tp / p_ END), 0e0) AS recall_at_fpr
       FROM c, tot),
nt AS (SELECT count(*) AS n, avg(label) AS base FROM pairs),
rk AS (SELECT label, row_number() OVER (ORDER BY score DESC, id) AS rn FROM pairs),
lift AS (SELECT
   (sum(CASE WHEN rn <= greatest(CAST(floor(n * 5e-2) AS BIGINT), 1) THEN label ELSE 0 END)
      / greatest(CAST(floor(max(n) * 5e-2) AS BIGINT), 1)) / greatest(max(base), 1e-9) AS lift_top_5pct,
   (sum(CASE WHEN rn <= greatest(CAST(floor(n * 1e-1) AS BIGINT), 1) THEN label ELSE 0 END)
      / greatest(CAST(floor(max(n) * 1e-1) AS BIGINT), 1)) / greatest(max(base), 1e-9) AS lift_top_10pct
   FROM rk, nt),
pw AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(label) AS positive_rate,
         avg(-(label * ln(least(greatest(score, 1e-7), 1 - 1e-7))
               + (1 - label) * ln(1 - least(greatest(score, 1e-7), 1 - 1e-7)))) AS log_loss,
         avg((score - label) * (score - label)) AS brier FROM pairs)
"""


def _curve(spark, sf, src=pairs):
    return E.curve_metrics(E.threshold_table(src(spark, sf)))


@register("E1_roc_auc", with_apps(_PAIRS + _CURVE + "SELECT round(roc_auc, 6) AS roc_auc FROM cm"))
def e1(spark, sf):
    return rounded(_curve(spark, sf).select("roc_auc"))


@register("E2_average_precision", with_apps(_PAIRS + _CURVE + "SELECT round(pr_auc, 6) AS pr_auc FROM cm"))
def e2(spark, sf):
    return rounded(_curve(spark, sf).select("pr_auc"))


@register("E3_ks_gini", with_apps(_PAIRS + _CURVE + """
SELECT round(ks, 6) AS ks, round(2 * roc_auc - 1, 6) AS gini FROM cm"""))
def e3(spark, sf):
    return rounded(_curve(spark, sf).select("ks", "gini"))


@register("E4_recall_at_fpr", with_apps(_PAIRS + _CURVE + """
SELECT round(recall_at_fpr, 6) AS recall_at_fpr_5pct FROM cm"""))
def e4(spark, sf):
    return rounded(_curve(spark, sf).select(F.col("recall_at_fpr").alias("recall_at_fpr_5pct")))


@register("E5_lift_top_k", with_apps(_PAIRS + _CURVE + """
SELECT round(lift_top_5pct, 6) AS lift_top_5pct, round(lift_top_10pct, 6) AS lift_top_10pct FROM lift"""))
def e5(spark, sf):
    p = pairs(spark, sf)
    t = E.threshold_table(p)
    return rounded(spark.createDataFrame([(E.lift_at_k(p, 0.05, t), E.lift_at_k(p, 0.1, t))],
                                         "lift_top_5pct double, lift_top_10pct double"))


@register("E6_logloss_brier", with_apps(_PAIRS + _CURVE + """
SELECT n, round(positive_rate, 6) AS positive_rate, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier FROM pw"""))
def e6(spark, sf):
    return rounded(E.pointwise_metrics(pairs(spark, sf)).withColumn("n", F.col("n").cast("double")))


_ALL_METRICS = """
SELECT round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(ks, 6) AS ks, round(2 * roc_auc - 1, 6) AS gini,
       round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round(recall_at_fpr, 6) AS recall_at_fpr_5pct,
       round(lift_top_5pct, 6) AS lift_top_5pct, round(lift_top_10pct, 6) AS lift_top_10pct, n,
       round(positive_rate, 6) AS positive_rate
FROM cm, lift, pw"""


@register("E1_E6_metrics_documents", _DOC_PAIRS + _CURVE + _ALL_METRICS)
def e_docs(spark, sf):
    return rounded(E.binary_metrics(doc_pairs(spark, sf)))


_SWEEP = """
, th AS (SELECT i / 100e0 AS threshold FROM range(1, 100) r(i)),
tot2 AS (SELECT count(*) AS n, sum(label) AS p FROM pairs),
sw AS (SELECT threshold,
         CAST(sum(CASE WHEN round(score, 6) >= threshold AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN round(score, 6) >= threshold AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp
       FROM th, pairs GROUP BY threshold),
cs AS (SELECT threshold, tp, fp, CAST(p - tp AS BIGINT) AS fn, CAST(n - p - fp AS BIGINT) AS tn, n, p FROM sw, tot2)
"""


@register("E7_cost_sweep", with_apps(_PAIRS + _SWEEP + """
SELECT threshold, round((tp + fp) / n, 6) AS review_rate, tp, fp, fn, tn, round(tp / greatest(p, 1), 6) AS recall,
       round(tp / greatest(tp + fp, 1), 6) AS precision, round(fn * 1200e0 + fp * 20e0, 6) AS total_cost,
       round((fn * 1200e0 + fp * 20e0) / n, 6) AS cost_per_applicant FROM cs"""))
def e7(spark, sf):
    return rounded(E.cost_sweep(pairs(spark, sf)))


@register("E8_optimal_threshold", with_apps(_PAIRS + _SWEEP + """
SELECT threshold, round(fn * 1200e0 + fp * 20e0, 6) AS total_cost FROM cs
ORDER BY fn * 1200e0 + fp * 20e0, threshold LIMIT 1"""))
def e8(spark, sf):
    return rounded(E.optimal_threshold(E.cost_sweep(pairs(spark, sf))))


@register("E9_loss_avoidance", with_apps(_PAIRS + """
, la AS (SELECT CAST(sum(CASE WHEN round(score, 6) >= 5e-1 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS frauds_caught,
                CAST(sum(CASE WHEN round(score, 6) >= 5e-1 AND label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS false_alarms,
                sum(label) AS pos FROM pairs)
SELECT frauds_caught, false_alarms, round(frauds_caught * 1200e0 - 1e-1 * pos * 1200e0, 6) AS gross_savings,
       round((frauds_caught + false_alarms) * 20e0, 6) AS review_cost,
       round(frauds_caught * 1200e0 - 1e-1 * pos * 1200e0 - (frauds_caught + false_alarms) * 20e0, 6) AS net_savings
FROM la"""))
def e9(spark, sf):
    return rounded(E.loss_avoidance(pairs(spark, sf), 0.5, baseline_recall=0.1))


@register("E10_group_report", with_apps(_PAIRS + """
, gp AS (SELECT p.id, p.label, p.score, l.addr_state AS grp FROM pairs p JOIN labelled l USING (id) WHERE l.addr_state IS NOT NULL),
t0 AS (SELECT score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM pairs GROUP BY score),
c0 AS (SELECT pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp FROM t0),
oa AS (SELECT sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS auc FROM c0),
ofpr AS (SELECT sum(CASE WHEN score >= 5e-1 AND label = 0 THEN 1 ELSE 0 END) / greatest(sum(1 - label), 1) AS fpr
         FROM pairs),
tg AS (SELECT grp, score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg
       FROM gp GROUP BY grp, score),
cg AS (SELECT grp, pos, neg, sum(pos) OVER (PARTITION BY grp ORDER BY score DESC) AS tp FROM tg),
ga AS (SELECT grp, sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS auc FROM cg GROUP BY grp),
gs AS (SELECT grp, count(*) AS n, avg(label) AS positive_rate,
         sum(CASE WHEN score >= 5e-1 AND label = 1 THEN 1 ELSE 0 END) AS tp,
         sum(CASE WHEN score >= 5e-1 AND label = 0 THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN score < 5e-1 AND label = 1 THEN 1 ELSE 0 END) AS fn,
         sum(CASE WHEN score < 5e-1 AND label = 0 THEN 1 ELSE 0 END) AS tn,
         count(DISTINCT label) AS k FROM gp GROUP BY grp)
SELECT gs.grp AS "group", gs.n, round(positive_rate, 6) AS positive_rate, round(ga.auc, 6) AS auc,
       round(ga.auc - (SELECT auc FROM oa), 6) AS auc_gap, round(tp / greatest(tp + fn, 1), 6) AS tpr,
       round(fp / greatest(fp + tn, 1), 6) AS fpr, round(fp / greatest(fp + tn, 1) - (SELECT fpr FROM ofpr), 6) AS fpr_gap,
       round((tn + fn) / n, 6) AS approval_rate
FROM gs JOIN ga USING (grp) WHERE n >= 200 AND k >= 2"""))
def e10(spark, sf):
    p = labelled(spark, sf, "score", "addr_state").select("id", F.col("is_fraud").alias("label"), _some_scores().alias("score"), "addr_state")
    return rounded(E.group_report(materialise(p, "group-pairs"), "addr_state"))


# ---------------------------------------------------------------- S1, S4-S8

_BAND = """CASE WHEN score >= 7e-1 THEN 'DECLINE' WHEN score >= 3e-1 THEN 'REVIEW' ELSE 'APPROVE' END"""


@register("S1_decision_banding", with_apps(f"""
SELECT id, {_BAND} AS decision, round(score, 6) AS fraud_score FROM applications"""))
def s1(spark, sf):
    return S.band(applications(spark, sf)).select("id", "decision", "fraud_score")


@register("S4_decision_counts", with_apps(f"""
SELECT {_BAND} AS decision, count(*) AS n FROM applications GROUP BY 1"""))
def s4(spark, sf):
    return S.decision_counts(S.band(applications(spark, sf)))


@register("S5_score_histogram", with_apps("""
, b AS (SELECT i / 20e0 AS le FROM range(0, 21) r(i) UNION ALL SELECT 'inf'::DOUBLE)
SELECT le, (SELECT count(*) FROM applications a WHERE round(a.score, 6) <= b.le) AS count FROM b"""))
def s5(spark, sf):
    return S.cumulative_histogram(S.band(applications(spark, sf)))


@register("S6_portfolio_kpis", with_apps(_PAIRS + """
SELECT count(*) AS n, round(avg(label), 6) AS fraud_rate, round(avg(score), 6) AS mean_score,
       round(avg(CASE WHEN score >= 5e-1 THEN 1 ELSE 0 END), 6) AS flag_rate FROM pairs"""))
def s6(spark, sf):
    return rounded(S.portfolio_kpis(pairs(spark, sf)))


@register("S7_score_histogram_by_label", with_apps(_PAIRS + """
SELECT CAST(least(greatest(floor(score * 40), 0), 39) AS INTEGER) AS bin, label, count(*) AS n FROM pairs
GROUP BY 1, 2"""))
def s7(spark, sf):
    return S.score_histogram(pairs(spark, sf))


@register("S8_decile_fraud_rate", with_apps(_PAIRS + """
, q AS (SELECT unnest(quantile_cont(score, [0e0, 1e-1, 2e-1, 3e-1, 4e-1, 5e-1, 6e-1, 7e-1, 8e-1, 9e-1, 1e0])) AS e
        FROM pairs),
e AS (SELECT DISTINCT round(e, 6) AS e FROM q),
m AS (SELECT count(*) AS m FROM e),
d AS (SELECT label, CAST(least(greatest((SELECT count(*) FROM e WHERE e.e < p.score) - 1, 0), (SELECT m FROM m) - 2)
                         + 1 AS INTEGER) AS decile FROM pairs p)
SELECT decile, count(*) AS n, round(avg(label), 6) AS fraud_rate FROM d GROUP BY decile"""))
def s8(spark, sf):
    return rounded(S.decile_rates(pairs(spark, sf)))


# ---------------------------------------------------------------- D1-D4

_DRIFT_COLS = ["loan_amnt", "annual_inc", "dti", "int_rate", "revol_util", "revol_bal", "emp_length",
               "open_acc", "total_acc", "score"]
_DEC9 = "[1e-1, 2e-1, 3e-1, 4e-1, 5e-1, 6e-1, 7e-1, 8e-1, 9e-1]"


def _psi_sql(exp_src: str, act_src: str, cols: list[str], min_n: int = 10) -> str:
    cl = ", ".join(cols)
    return f"""
, ex AS (SELECT feature, x FROM (SELECT {cl} FROM {exp_src}) UNPIVOT (x FOR feature IN ({cl})) WHERE NOT isnan(x)),
ac AS (SELECT feature, x FROM (SELECT {cl} FROM {act_src}) UNPIVOT (x FOR feature IN ({cl})) WHERE NOT isnan(x)),
qe AS (SELECT feature, unnest(quantile_cont(x, {_DEC9})) AS e FROM ex GROUP BY feature),
ed AS (SELECT feature, round(e, 6) AS e FROM qe),
eb AS (SELECT x.feature, (SELECT count(*) FROM ed WHERE ed.feature = x.feature AND ed.e <= x.x) AS bin FROM ex x),
ab AS (SELECT x.feature, (SELECT count(*) FROM ed WHERE ed.feature = x.feature AND ed.e <= x.x) AS bin FROM ac x),
en AS (SELECT feature, count(*) AS n FROM ex GROUP BY feature),
an AS (SELECT feature, count(*) AS n FROM ac GROUP BY feature),
grid AS (SELECT feature, b AS bin FROM (SELECT DISTINCT feature FROM ed), range(0, 10) r(b)),
ec AS (SELECT feature, bin, count(*) AS c FROM eb GROUP BY feature, bin),
acn AS (SELECT feature, bin, count(*) AS c FROM ab GROUP BY feature, bin),
pc AS (SELECT g.feature, greatest(coalesce(ec.c, 0) / en.n, 1e-6) AS e, greatest(coalesce(acn.c, 0) / an.n, 1e-6) AS a
       FROM grid g JOIN en USING (feature) JOIN an USING (feature)
       LEFT JOIN ec ON ec.feature = g.feature AND ec.bin = g.bin
       LEFT JOIN acn ON acn.feature = g.feature AND acn.bin = g.bin
       WHERE an.n >= {min_n}),
rep AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM pc GROUP BY feature)
"""


_SPLIT_SRC = _P1_SQL + """
, tr AS (SELECT a.* FROM applications a JOIN s USING (id) WHERE s.split = 'train'),
te_ AS (SELECT a.* FROM applications a JOIN s USING (id) WHERE s.split = 'test')
"""


def _split_frames(spark, sf):
    narrow = materialise(applications(spark, sf).select("id", "issue_d", *_DRIFT_COLS), "drift-input")
    a = P.time_split(narrow)
    return a.where(F.col("split") == "train"), a.where(F.col("split") == "test")


@register("D1_psi", with_apps(_SPLIT_SRC + _psi_sql("tr", "te_", ["annual_inc"], 0) + """
SELECT round(psi, 6) AS psi FROM rep"""))
def d1(spark, sf):
    tr, te = _split_frames(spark, sf)
    return rounded(spark.createDataFrame([(D.psi(tr, te, "annual_inc"),)], "psi double"))


@register("D2_drift_reference", with_apps(_SPLIT_SRC + _psi_sql("tr", "te_", _DRIFT_COLS) + """
SELECT g.feature, g.bin, round(greatest(coalesce(ec.c, 0) / en.n, 1e-6), 6) AS expected_pct
FROM grid g JOIN en USING (feature) LEFT JOIN ec ON ec.feature = g.feature AND ec.bin = g.bin"""))
def d2(spark, sf):
    tr, _ = _split_frames(spark, sf)
    return rounded(D.fit_reference(tr, _DRIFT_COLS).expected)


@register("D3_psi_report", with_apps(_SPLIT_SRC + _psi_sql("tr", "te_", _DRIFT_COLS) + """
SELECT feature, round(psi, 6) AS psi, psi > 2e-1 AS alert FROM rep"""))
def d3(spark, sf):
    tr, te = _split_frames(spark, sf)
    return rounded(D.fit_reference(tr, _DRIFT_COLS).psi_report(te))


def _events_psi_sql() -> str:
    return f"""
WITH evl AS (SELECT event_type AS feature, value AS x, ts < TIMESTAMP '2024-01-16 00:00:00' AS early FROM events
             WHERE value IS NOT NULL AND NOT isnan(value)),
ex AS (SELECT feature, x FROM evl WHERE early), ac AS (SELECT feature, x FROM evl WHERE NOT early),
qe AS (SELECT feature, unnest(quantile_cont(x, {_DEC9})) AS e FROM ex GROUP BY feature),
ed AS (SELECT feature, round(e, 6) AS e FROM qe),
eb AS (SELECT x.feature, (SELECT count(*) FROM ed WHERE ed.feature = x.feature AND ed.e <= x.x) AS bin FROM ex x),
ab AS (SELECT x.feature, (SELECT count(*) FROM ed WHERE ed.feature = x.feature AND ed.e <= x.x) AS bin FROM ac x),
en AS (SELECT feature, count(*) AS n FROM ex GROUP BY feature),
an AS (SELECT feature, count(*) AS n FROM ac GROUP BY feature),
grid AS (SELECT feature, b AS bin FROM (SELECT DISTINCT feature FROM ed), range(0, 10) r(b)),
ec AS (SELECT feature, bin, count(*) AS c FROM eb GROUP BY feature, bin),
acn AS (SELECT feature, bin, count(*) AS c FROM ab GROUP BY feature, bin),
pc AS (SELECT g.feature, greatest(coalesce(ec.c, 0) / en.n, 1e-6) AS e, greatest(coalesce(acn.c, 0) / an.n, 1e-6) AS a
       FROM grid g JOIN en USING (feature) JOIN an USING (feature)
       LEFT JOIN ec ON ec.feature = g.feature AND ec.bin = g.bin
       LEFT JOIN acn ON acn.feature = g.feature AND acn.bin = g.bin WHERE an.n >= 10),
rep AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM pc GROUP BY feature)
SELECT feature, round(psi, 6) AS psi, psi > 2e-1 AS alert FROM rep"""


@register("D3_psi_report_events", _events_psi_sql())
def d3_events(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_type").alias("feature"), F.col("value").alias("x"), "ts")
    cut = F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))
    return rounded(D.psi_of_long(ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut)))


@register("D4_top_features", with_apps(_SPLIT_SRC + _psi_sql("tr", "te_", _DRIFT_COLS) + """
SELECT feature, round(psi, 6) AS psi, psi > 2e-1 AS alert FROM rep ORDER BY psi DESC, feature LIMIT 20"""))
def d4_top(spark, sf):
    tr, te = _split_frames(spark, sf)
    return rounded(D.alert_summary(D.fit_reference(tr, _DRIFT_COLS).psi_report(te))[1])


@register("D4_alert_summary", with_apps(_SPLIT_SRC + _psi_sql("tr", "te_", _DRIFT_COLS) + """
SELECT CAST(sum(CASE WHEN psi > 2e-1 THEN 1 ELSE 0 END) AS BIGINT) AS n_alerts, count(*) AS n_features FROM rep"""))
def d4(spark, sf):
    tr, te = _split_frames(spark, sf)
    n_alerts, _ = D.alert_summary(D.fit_reference(tr, _DRIFT_COLS).psi_report(te))
    return n_alerts.select(F.col("n_alerts").cast("long"), "n_features")


# ---------------------------------------------------------------- S4, S5, D3 per window of a stream, V2 on a stream

_WINDOW = "30 days"
_WINDOW_OF = "TIMESTAMP '1970-01-01' + CAST(floor(({day}) / 30) AS INTEGER) * INTERVAL 30 DAY"
_APP_DAY = "CAST(issue_d AS DATE) - DATE '1970-01-01'"


def _delivered(spark, frame, time_col, start, name):
    """Rows in two deliveries, then two rows far in the future, which close all windows before them; a run after each."""
    src = scratch_path(spark, f"{name}-source")
    far = [frame.limit(1).withColumn(time_col, F.date_add(F.lit("2100-01-01").cast("date"), days).cast("timestamp_ntz")) for days in (37000, 75000)]
    for part in (frame.where("id % 2 = 0"), frame.where("id % 2 <> 0"), *far):
        part.write.mode("append").parquet(src)
        start(src, frame.schema)


@register("S5_streaming_decision_windows", with_apps(f"""
SELECT CAST({_WINDOW_OF.format(day=_APP_DAY)} AS TIMESTAMP) AS window_start, CASE WHEN id % 3 = 0 THEN 'batch' ELSE 'one' END AS endpoint,
       CASE WHEN score >= 7e-1 THEN 'DECLINE' WHEN score >= 3e-1 THEN 'REVIEW' ELSE 'APPROVE' END AS decision,
       CAST(least(greatest(ceil(round(score, 6) * 20), 0), 20) AS INTEGER) AS score_bin, count(*) AS n
FROM applications WHERE issue_d IS NOT NULL GROUP BY 1, 2, 3, 4"""))
def s5_windows(spark, sf):
    """Decisions by endpoint and score bins per 30-day window, counted by a watermarked stream in two deliveries."""
    a = applications(spark, sf).where("issue_d IS NOT NULL").select(
        "id", F.col("issue_d").cast("timestamp_ntz").alias("ts"), "score", F.when(F.col("id") % 3 == 0, "batch").otherwise("one").alias("endpoint"))
    sink, progress = (scratch_path(spark, f"window-{x}") for x in ("sink", "progress"))
    _delivered(spark, a, "ts", lambda src, schema: MO.decision_windows_stream(
        spark, src, schema, sink, progress, "ts", _WINDOW, "36500 days"), "windows")
    return spark.read.schema("window_start timestamp_ntz, endpoint string, decision string, score_bin int, n long").parquet(sink) \
        .where("window_start < timestamp_ntz'2090-01-01'")


@register("D3_streaming_psi_windows", with_apps(_SPLIT_SRC + _psi_sql("tr", "te_", _DRIFT_COLS) + f"""
, wv AS (SELECT w, feature, x FROM (SELECT CAST({_WINDOW_OF.format(day=_APP_DAY)} AS TIMESTAMP) AS w, {", ".join(_DRIFT_COLS)}
       FROM applications WHERE issue_d IS NOT NULL) UNPIVOT (x FOR feature IN ({", ".join(_DRIFT_COLS)})) WHERE NOT isnan(x)),
wb AS (SELECT w, feature, (SELECT count(*) FROM ed WHERE ed.feature = wv.feature AND ed.e <= wv.x) AS bin FROM wv),
wc AS (SELECT w, feature, bin, count(*) AS c FROM wb GROUP BY 1, 2, 3),
wn AS (SELECT w, feature, sum(c) AS n FROM wc GROUP BY 1, 2),
wp AS (SELECT wn.w, g.feature, greatest(coalesce(ec.c, 0) / en.n, 1e-6) AS e, greatest(coalesce(wc.c, 0) / wn.n, 1e-6) AS a
       FROM wn JOIN grid g USING (feature) JOIN en USING (feature) LEFT JOIN ec ON ec.feature = g.feature AND ec.bin = g.bin
       LEFT JOIN wc ON wc.w = wn.w AND wc.feature = g.feature AND wc.bin = g.bin WHERE wn.n >= 10)
SELECT w AS window_start, feature, round(sum((a - e) * ln(a / e)), 6) AS psi, sum((a - e) * ln(a / e)) > 2e-1 AS alert FROM wp GROUP BY 1, 2"""))
def d3_windows(spark, sf):
    """PSI of each feature in each 30-day window against the training rows, from bin counts of a watermarked stream."""
    tr, _ = _split_frames(spark, sf)
    reference = D.fit_reference(tr, _DRIFT_COLS)
    a = applications(spark, sf).where("issue_d IS NOT NULL").select("id", F.col("issue_d").cast("timestamp_ntz").alias("ts"), *_DRIFT_COLS)
    sink, progress = (scratch_path(spark, f"drift-{x}") for x in ("sink", "progress"))
    _delivered(spark, materialise(a, "drift-stream"), "ts", lambda src, schema: MO.drift_windows_stream(
        spark, src, schema, reference, sink, progress, "ts", _WINDOW, "36500 days"), "drift")
    counts = spark.read.schema("window_start timestamp_ntz, feature string, bin int, n long").parquet(sink).where("window_start < timestamp_ntz'2090-01-01'")
    return rounded(MO.psi_by_window(counts, reference))


@register("V2_stream_unique", with_apps("""
SELECT id, 'accepted' AS outcome, 1 AS n FROM applications WHERE issue_d IS NOT NULL
UNION ALL SELECT id, 'repeated', CASE WHEN id % 10 = 0 THEN 2 ELSE 1 END FROM applications WHERE issue_d IS NOT NULL AND id % 5 = 0
UNION ALL SELECT id, 'no time', 1 FROM applications WHERE issue_d IS NULL"""))
def v2_stream(spark, sf):
    """Applications as requests: every fifth is delivered twice, every tenth three times; each id passes once, all else is listed."""
    a = materialise(applications(spark, sf).select("id", "issue_d", "loan_amnt"), "requests")
    src, sink, bad, state, progress = (scratch_path(spark, f"unique-{x}") for x in ("source", "sink", "rejects", "state", "progress"))
    for part in (a.unionByName(a.where("id % 10 = 0 AND issue_d IS NOT NULL")), a.where("id % 5 = 0 AND issue_d IS NOT NULL")):
        part.write.mode("append").parquet(src)
        MO.unique_requests_stream(spark, src, a.schema, sink, bad, state, progress, "issue_d", "36500 days")
    got = spark.read.parquet(sink).select("id", F.lit("accepted").alias("outcome"))
    out = spark.read.parquet(bad).select(F.col("id").cast("long").alias("id"), F.col("reason").alias("outcome"))
    return got.unionByName(out).groupBy("id", "outcome").agg(F.count(F.lit(1)).cast("int").alias("n"))
