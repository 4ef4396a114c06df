"""Registered queries: models (M1-M13), batch and streaming scoring (S2, S3, S9), explanations."""

from __future__ import annotations

import sys
from functools import partial

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ...functions import normalize as N
from ...operators import scoring as S
from ...operators import split as P
from ...sources.applications import applications
from ...sources.io import scratch_path
from ...sources.scratch import materialise, side_by_side
from ...streaming import scoring as ST
from .. import explain as EX
from .. import models as M
from .. import search as SE
from .. import training as T
from ..registry import register, rounded, with_apps
from .labels import LABELLED_CTES, labelled
from .prep import _V3_SQL as V3_SQL
from .prep import request_rows
from .windows import _P1_SQL

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NUM = ["loan_amnt", "annual_inc", "dti", "int_rate", "revol_util", "revol_bal", "emp_length", "open_acc",
        "total_acc", "delinq_2yrs", "pub_rec", "term"]


def _matrix(spark, sf):
    """Labelled applications with a numeric feature vector (NULL -> 0)."""
    lab = labelled(spark, sf).select("id", F.col("is_fraud").alias("label"), "issue_d",
                                     *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in _NUM])
    return M.assemble(materialise(lab, "matrix"), _NUM)


def _training_input(spark, sf):
    """The application frame of the training queries, with its installment."""
    return applications(spark, sf).withColumn("installment", N.installment("loan_amnt", "int_rate", "term"))


_TRAINED: dict = {}


def _trained(spark, sf):
    """The training job's result, kept for the queries that read its outputs (same session and data):
    any of them trains when it is the first."""
    key = (id(spark), sf)
    if key not in _TRAINED:
        _TRAINED.clear()
        _TRAINED[key] = T.train(_training_input(spark, sf))
    return _TRAINED[key]


@register("M1_class_weights", with_apps(LABELLED_CTES + """
, p AS (SELECT avg(is_fraud) AS p FROM labelled)
SELECT is_fraud AS label, round(CASE WHEN is_fraud = 1 THEN (1 - p) / p ELSE 1e0 END, 6) AS weight, count(*) AS n
FROM labelled, p GROUP BY 1, 2"""))
def m1(spark, sf):
    w = M.class_weights(labelled(spark, sf).withColumnRenamed("is_fraud", "label"))
    return rounded(w.groupBy("label", "weight").agg(F.count(F.lit(1)).alias("n")))


@register("M2_M3_gbt_importance")
def m2(spark, sf):
    x = _matrix(spark, sf)
    model = M.fit_gbt(x, "xgboost", max_iter=T.TrainSettings().rounds)
    return M.feature_importance(model, _NUM)


@register("M2_gbt_scores")
def m2_scores(spark, sf):
    return _gbt_scores(_matrix(spark, sf))


def _gbt_scores(x):
    s = P.time_split(x)
    model = M.fit_gbt(s.where(F.col("split") == "train"), "lightgbm", max_iter=T.TrainSettings().rounds,
                      validation=s.where(F.col("split") == "val"))
    return M.score_with(model, s.where(F.col("split") == "test"), "score").select("id", "label", "score")


@register("M4_isolation_forest")
def m4(spark, sf):
    return _isolation_scores(_matrix(spark, sf))


def _isolation_scores(x):
    return M.fit_isolation_forest(x).score(x, out="score").select("id", "label", "score")


@register("M5_reconstruction_error")
def m5(spark, sf):
    return _reconstruction_errors(_matrix(spark, sf))


def _reconstruction_errors(x):
    return M.fit_reconstruction(x, k=4).score(x, out="score").select("id", "label", "score")


@register("M6_minmax_scaling", with_apps("""
, x AS (SELECT id, CASE WHEN id % 97 <> 0 THEN score END AS score FROM applications),
b AS (SELECT round(quantile_cont(score, 1e-2), 6) AS lo, round(quantile_cont(score, 99e-2), 6) AS hi FROM x)
SELECT id, CASE WHEN score IS NOT NULL THEN round(least(greatest((score - lo) / (hi - lo), 0e0), 1e0), 6) END AS scaled
FROM x, b"""))
def m6(spark, sf):
    a = applications(spark, sf).select("id", F.when(F.col("id") % 97 != 0, F.col("score")).alias("score"))
    lo, hi = M.minmax_bounds(a, "score")
    return rounded(a.select("id", M.minmax("score", lo, hi).alias("scaled")))


@register("M11_threshold_prediction", with_apps("""
SELECT id, CAST(score >= 5e-1 AS INTEGER) AS prediction FROM applications"""))
def m11(spark, sf):
    return M.predict(applications(spark, sf)).select("id", "prediction")


@register("M12_random_search")
def m12(spark, sf):
    """Two trials of the search, the second by resuming the table of the first; shallower and shorter than the default ranges."""
    s = materialise(P.time_split(_matrix(spark, sf)).select("id", "label", "features", "split"), "search-input")
    value = SE.boosted_trees_objective(*[s.where(F.col("split") == x).drop("split") for x in ("train", "val")])
    smaller = {"maxDepth": (3, 6), "maxIter": (5, 15)}
    ranges = [SE.Range(r.name, *smaller.get(r.name, (r.low, r.high)), r.kind) for r in SE.RANGES]
    path = scratch_path(spark, "trials")
    for n in (1, 2):
        found = SE.search(spark, value, path, n, ranges=ranges)
    return found.drop("seconds")


@register("M7_oof_scores")
def m7(spark, sf):
    return _fold_scores(_matrix(spark, sf))


def _fold_scores(x):
    return M.oof_scores(x, ["xgboost", "reconstruction"], k=3, max_iter=5)


@register("M8_M10_ensemble_test_scores")
def m8(spark, sf):
    r = _trained(spark, sf)
    return r.test_scores


@register("M13_training_report")
def m13(spark, sf):
    return _trained(spark, sf).report


@register("E8_training_optimal_threshold")
def e8_training(spark, sf):
    return _trained(spark, sf).sweep.orderBy("total_cost", "threshold").limit(1)


def _explained(spark, sf):
    """The test-period requests with the contributions of all features, as the scoring job computes them."""
    r = _trained(spark, sf)
    x = M.assemble(r.features.transform(materialise(_requests(spark, sf), "requests")), r.features.feature_names)
    return r, EX.margin_parts(r.ensemble.score(x), r.ensemble)


@register("E11_global_importance")
def e11(spark, sf):
    """Mean absolute contribution of the applicant's features to the ensemble's margin, the 20 largest."""
    r, x = _explained(spark, sf)
    return EX.feature_importance(x, r.features.feature_names)


@register("E12_contributions_add_up", with_apps(_P1_SQL + """
SELECT id, true AS all_features, 0e0 AS rest, true AS same_margin FROM s WHERE split = 'test'"""))
def e12_adds_up(spark, sf):
    """Of every test row: whether each feature has a part, what base and parts lack of the margin, and whether the margin is the model's own."""
    r, x = _explained(spark, sf)
    own = F.log(F.col("meta_score") / (1 - F.col("meta_score")))
    total = F.aggregate("parts", F.col("base_margin"), lambda a, b: a + b)
    return x.select("id", (F.size("parts") == len(r.features.feature_names)).alias("all_features"), F.abs(F.round(total - F.col("margin"), 6)).alias("rest"),
                    (F.abs(own - F.col("margin")) < 1e-6).alias("same_margin"))


# Two small trees over application columns, by hand: (feature, threshold, left, right, value) per node, -1 a leaf.
_HAND_NAMES = ["loan_amnt", "dti", "int_rate"]
_HAND_TREES = [
    [(1, 30.0, 1, 2, 0.1), (0, 9000.0, 3, 4, -0.2), (2, 12.0, 5, 6, 0.5), (-1, 0.0, -1, -1, -0.4), (-1, 0.0, -1, -1, 0.05),
     (-1, 0.0, -1, -1, 0.3), (-1, 0.0, -1, -1, 0.9)],
    [(2, 9.0, 1, 2, 0.0), (-1, 0.0, -1, -1, -0.3), (1, 45.0, 3, 4, 0.25), (-1, 0.0, -1, -1, 0.1), (-1, 0.0, -1, -1, 0.8)]]


@register("E12_tree_contributions", with_apps("""
, x AS (SELECT id, coalesce(loan_amnt, 0e0) AS loan, coalesce(dti, 0e0) AS dti, coalesce(int_rate, 0e0) AS rate FROM applications),
t AS (SELECT id,
  CASE WHEN dti <= 30 THEN CASE WHEN loan <= 9000 THEN -2e-1 ELSE 25e-2 END ELSE 0e0 END AS p_loan,
  CASE WHEN dti <= 30 THEN -3e-1 ELSE 4e-1 END
    + 5e-1 * CASE WHEN rate > 9 THEN CASE WHEN dti <= 45 THEN -15e-2 ELSE 55e-2 END ELSE 0e0 END AS p_dti,
  CASE WHEN dti > 30 THEN CASE WHEN rate <= 12 THEN -2e-1 ELSE 4e-1 END ELSE 0e0 END
    + 5e-1 * CASE WHEN rate <= 9 THEN -3e-1 ELSE 25e-2 END AS p_rate FROM x)
SELECT id, round(p_loan, 6) AS loan_amnt, round(p_dti, 6) AS dti, round(p_rate, 6) AS int_rate,
       round(1e-1 + p_loan + p_dti + p_rate, 6) AS output FROM t"""))
def e12_trees(spark, sf):
    """Path contributions of the two hand-made trees (weights 1 and 0.5) for every application."""
    trees = [EX.Tree(*[np.array(c, int if i in (0, 2, 3) else float) for i, c in enumerate(zip(*t))]) for t in _HAND_TREES]

    def work(batches):
        for b in batches:
            base, parts = EX.path_parts(b[_HAND_NAMES].to_numpy(), trees, [1.0, 0.5])
            yield pd.DataFrame({"id": b["id"], **{n: parts[:, i] for i, n in enumerate(_HAND_NAMES)}, "output": base + parts.sum(axis=1)})

    x = applications(spark, sf).select("id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in _HAND_NAMES])
    return rounded(x.mapInPandas(work, "id long, loan_amnt double, dti double, int_rate double, output double"))


def _requests(spark, sf):
    """Scoring requests: the test-period applications without outcome columns."""
    s = P.time_split(materialise(_training_input(spark, sf), "requests"))
    return P.drop_leakage(s.where(F.col("split") == "test").drop("split", "score"))


@register("S2_batch_scoring")
def s2(spark, sf):
    r = _trained(spark, sf)
    return T.score_batch(r, _requests(spark, sf), "2024-01-01 00:00:00")


@register("S2_contract_outcome", with_apps(V3_SQL + """
SELECT id, CASE WHEN id IN (SELECT id FROM v) THEN 'quarantined' ELSE 'scored' END AS outcome FROM src"""))
def s2_contract(spark, sf):
    """Requests with dates as text (some unreadable) through the gate and the model: each is scored or quarantined."""
    req = request_rows(spark, sf).withColumn("issue_d", F.when(F.col("id") % 13 == 0, F.lit("not-a-date"))
                                             .otherwise(F.date_format("issue_d", "yyyy-MM-dd")))
    bad = scratch_path(spark, "quarantine")
    scored = T.score_batch(_trained(spark, sf), req, "2024-01-01 00:00:00", quarantine_dir=bad)
    return scored.select(F.col("application_id").alias("id"), F.lit("scored").alias("outcome")).unionByName(
        spark.read.parquet(bad).select("id").distinct().select("id", F.lit("quarantined").alias("outcome")))


@register("IO6_trained_model_roundtrip", with_apps(_P1_SQL + """
SELECT id, true AS same FROM s WHERE split = 'test'"""))
def io6_model(spark, sf):
    """The trained job saved and loaded again scores the test rows alike."""
    r = _trained(spark, sf)
    path = scratch_path(spark, "trained")
    r.save(path)
    again = T.TrainingResult.load(spark, path)
    req = materialise(_requests(spark, sf), "requests")
    a, b = (T.score_batch(x, req, "2024-01-01 00:00:00") for x in (r, again))
    return a.select(F.col("application_id").alias("id"), F.col("fraud_score").alias("x")).join(
        b.select(F.col("application_id").alias("id"), F.col("fraud_score").alias("y")), "id") \
        .select("id", F.col("x").eqNullSafe(F.col("y")).alias("same"))


@register("E12_reason_codes")
def e12(spark, sf):
    """Every row's reasons in full: rank, input, value, contribution, direction."""
    out = s2(spark, sf).withColumnRenamed("application_id", "id")
    return S.reason_table(out)


@register("S9_reason_table")
def s9(spark, sf):
    out = s2(spark, sf).withColumnRenamed("application_id", "id")
    return S.reason_table(out)


@register("S3_streaming_scoring")
def s3(spark, sf):
    r = _trained(spark, sf)
    req = _requests(spark, sf)
    src = scratch_path(spark, "stream-requests")
    req.repartition(4).write.parquet(src)
    sink = scratch_path(spark, "stream-scored")
    ST.model_scoring_stream(spark, src, req.schema, r, "2024-01-01 00:00:00", sink, scratch_path(spark, "stream-progress"))
    return spark.read.parquet(sink).drop("epoch")


@register("S3_streaming_banding", with_apps("""
SELECT id, CASE WHEN score >= 7e-1 THEN 'DECLINE' WHEN score >= 3e-1 THEN 'REVIEW' ELSE 'APPROVE' END AS decision,
       round(score, 6) AS fraud_score FROM applications"""))
def s3_banding(spark, sf):
    a = applications(spark, sf).select("id", "score")
    src = scratch_path(spark, "stream-source")
    a.repartition(4).write.parquet(src)
    sink = scratch_path(spark, "stream-banded")
    ST.banding_stream(spark, src, a.schema, sink, scratch_path(spark, "stream-progress"))
    return spark.read.parquet(sink).drop("epoch")


@register("S4_streaming_decision_counts", with_apps("""
SELECT CASE WHEN score >= 7e-1 THEN 'DECLINE' WHEN score >= 3e-1 THEN 'REVIEW' ELSE 'APPROVE' END AS decision,
       count(*) AS n FROM applications GROUP BY 1"""))
def s4_stream(spark, sf):
    a = applications(spark, sf).select("id", "score")
    src = scratch_path(spark, "stream-source-agg")
    a.repartition(4).write.parquet(src)
    sink = scratch_path(spark, "stream-counts")
    ST.decision_count_stream(spark, src, a.schema, sink, scratch_path(spark, "stream-progress"))
    return spark.read.parquet(f"{sink}/totals")


@register("M8_meta_coefficients")
def m8_coef(spark, sf):
    r = _trained(spark, sf)
    coefs = r.ensemble.meta.coefficients.toArray().tolist()
    return spark.createDataFrame([(n, float(c)) for n, c in zip(r.ensemble.names, coefs)] +
                                 [("intercept", float(r.ensemble.meta.intercept))], "input string, coefficient double")


# ---------------------------------------------------------------- twins of what a fit does not decide

# A fixed linear model over application columns: contributions coef * (x - mean) have an exact twin.
_LINEAR = {"loan_amnt": (4.1373731e-5, 15000.0), "annual_inc": (-2.1377317e-6, 450000.0), "dti": (0.0317317, 30.0), "int_rate": (0.1113177, 10.0),
           "open_acc": (-0.05, 7.0), "total_acc": (0.02, 15.0), "delinq_2yrs": (0.4, 1.5)}
_LINEAR_SQL = with_apps(", c AS (" + " UNION ALL ".join(
    f"SELECT id, {i} AS pos, '{c}' AS feature, coalesce({c}, 0e0) AS value, {k!r} * (coalesce({c}, 0e0) - {m!r}) AS contribution "
    f"FROM applications" for i, (c, (k, m)) in enumerate(_LINEAR.items())) + """)
, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(contribution) DESC, pos) AS rank FROM c)
""")


def _linear_frame(spark, sf):
    return applications(spark, sf).select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in _LINEAR])


def _linear_parts():
    return list(_LINEAR), [k for k, _ in _LINEAR.values()], {c: m for c, (_, m) in _LINEAR.items()}


@register("E12_S9_linear_reasons", _LINEAR_SQL + """
SELECT id, CAST(rank AS INTEGER) AS rank, feature, round(value, 6) AS value, round(contribution, 6) AS contribution,
       CASE WHEN contribution > 0 THEN 'up fraud' ELSE 'down fraud' END AS direction FROM r WHERE rank <= 5""")
def e12_linear(spark, sf):
    return rounded(S.reason_table(T.reason_codes(_linear_frame(spark, sf), *_linear_parts())))


@register("E11_linear_importance", _LINEAR_SQL + """
SELECT feature, round(avg(abs(contribution)), 6) AS mean_abs_contribution FROM r GROUP BY feature""")
def e11_linear(spark, sf):
    return rounded(T.global_importance(_linear_frame(spark, sf), *_linear_parts()))


# Isotonic regression as the slopes of the greatest convex minorant of (count, positives): from each
# corner the next one is the point with the least slope, of equal slopes the farthest.
_HULL_SQL = """
, point AS (SELECT score AS x, CAST(sum(is_fraud) AS BIGINT) AS y, count(*) AS w FROM {rows} GROUP BY score),
rising AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(y) OVER (ORDER BY x) AS sy, sum(w) OVER (ORDER BY x) AS sw FROM point),
z AS (SELECT i, sy, sw FROM rising UNION ALL SELECT 0, 0, 0),
hull(i, sy, sw, slope) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS HUGEINT), CAST(0 AS HUGEINT), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT n.i, n.sy, n.sw, n.slope FROM hull h, LATERAL (
    SELECT z.i, CAST(z.sy AS HUGEINT) AS sy, CAST(z.sw AS HUGEINT) AS sw, CAST(z.sy - h.sy AS DOUBLE) / CAST(z.sw - h.sw AS DOUBLE) AS slope
    FROM z WHERE z.i > h.i ORDER BY slope, z.i DESC LIMIT 1) n),
fit AS (SELECT r.x, (SELECT arg_min(slope, i) FROM hull WHERE hull.i >= r.i AND hull.i > 0) AS value FROM rising r)
"""


@register("M9_isotonic_fit", with_apps(LABELLED_CTES + _HULL_SQL.format(rows="labelled") + """
SELECT x AS score, round(value, 6) AS calibrated FROM fit""").replace("WITH ", "WITH RECURSIVE ", 1))
def m9_fit(spark, sf):
    """Calibration at full score precision; the twin walks the convex minorant."""
    lab = labelled(spark, sf, "score").select(F.col("score").alias("meta_score"), F.col("is_fraud").alias("label"))
    lab = materialise(lab, "isotonic-input")
    out = M.fit_isotonic(lab).transform(lab.select("meta_score").distinct())
    return rounded(out.select(F.col("meta_score").alias("score"), F.col("_iso").alias("calibrated")))


@register("M9_isotonic_calibration", with_apps(LABELLED_CTES + _P1_SQL + """
, val AS (SELECT l.* FROM labelled l JOIN s USING (id) WHERE s.split = 'val')""" + _HULL_SQL.format(rows="val") + """
, test AS (SELECT l.id, l.score FROM labelled l JOIN s USING (id) WHERE s.split = 'test'),
lo AS (SELECT t.id, t.score, f.x AS lx, f.value AS lv FROM test t ASOF LEFT JOIN fit f ON t.score >= f.x),
near AS (SELECT lo.*, f.x AS hx, f.value AS hv FROM lo ASOF LEFT JOIN fit f ON lo.score <= f.x)
SELECT id, round(score, 6) AS meta_score, round(CASE WHEN lx IS NULL THEN hv WHEN hx IS NULL OR hx = lx THEN lv
         ELSE lv + (hv - lv) * (score - lx) / (hx - lx) END, 6) AS calibrated FROM near""").replace("WITH ", "WITH RECURSIVE ", 1))
def m9(spark, sf):
    """Calibration fitted on the validation rows, applied to the test rows: constant outside the fitted range,
    interpolated between fitted scores."""
    lab = labelled(spark, sf, "score").select("id", "issue_d", F.col("is_fraud").alias("label"),
                                     F.col("score").alias("meta_score"))
    s = P.time_split(materialise(lab, "calibration-input"))
    iso = M.fit_isotonic(s.where(F.col("split") == "val"))
    return rounded(iso.transform(s.where(F.col("split") == "test")).select("id", "meta_score", F.col("_iso").alias("calibrated")))


@register("M2_M4_M5_M7_score_invariants", with_apps(_P1_SQL + """
, n AS (SELECT count(*) AS n FROM applications)
SELECT m AS model, CASE WHEN m = 'M2' THEN (SELECT count(*) FROM s WHERE split = 'test') ELSE n END AS n_ids, 0 AS n_outside
FROM n, (VALUES ('M2'), ('M4'), ('M5'), ('M7')) v(m)"""))
def score_invariants(spark, sf):
    """Every id has one score, none is missing or outside [0, 1]."""
    x = _matrix(spark, sf)      # one table for the four models
    m2, m4_, m5_, m7_ = side_by_side(spark, [partial(f, x) for f in (_gbt_scores, _isolation_scores, _reconstruction_errors, _fold_scores)])
    frames = {"M2": m2, "M4": m4_, "M5": m5_, "M7": m7_.withColumn("score", F.least("xgboost", "reconstruction"))}
    rows = [f.select(F.lit(name).alias("model"), "id", "score") for name, f in frames.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    outside = F.sum((F.col("score").isNull() | (F.col("score") < 0) | (F.col("score") > 1)).cast("int"))
    return out.groupBy("model").agg(F.countDistinct("id").alias("n_ids"), outside.cast("int").alias("n_outside"))


@register("M8_meta_optimum", "SELECT true AS flat, true AS importance_sums_to_one")
def m8_optimum(spark, sf):
    """At the fitted meta coefficients the gradient of the penalised log loss vanishes; importances sum to 1."""
    x = _matrix(spark, sf)
    oof = M.oof_scores(x, ["reconstruction"], k=3)
    meta = M.fit_meta(oof, ["reconstruction"])
    n = oof.count()
    c, b = float(meta.coefficients[0]), float(meta.intercept)
    p = 1 / (1 + F.exp(-(F.col("reconstruction") * c + b)))
    g = oof.agg(F.avg((p - F.col("label")) * F.col("reconstruction")), F.avg(p - F.col("label"))).first()
    flat = abs(g[0] + c / n) < 1e-4 and abs(g[1]) < 1e-4
    gbt = M.fit_gbt(x, "xgboost", max_iter=2)
    total = M.feature_importance(gbt, _NUM).agg(F.sum("importance")).first()[0]
    return spark.createDataFrame([(flat, abs(total - 1) < 1e-9)], "flat boolean, importance_sums_to_one boolean")
