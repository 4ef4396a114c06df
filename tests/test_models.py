"""Model invariants: scores in [0, 1], no NULLs, OOF covers every row,
AUC above 0.5 on a planted signal, isotonic output monotone in the raw score."""

import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.operators import evaluate as E
from riskweave.plans import features as FE
from riskweave.plans import models as M
from riskweave.plans import training as T
from riskweave.sources import scratch


def planted(spark, n=600):
    # label depends on x0 (signal) and not on x1 (noise)
    df = spark.range(n).select(F.col("id"), (F.col("id") % 97 / 97.0).alias("x0"), (F.col("id") * 31 % 89 / 89.0).alias("x1"))
    df = df.withColumn("label", (F.col("x0") > 0.8).cast("int"))
    return M.assemble(df, ["x0", "x1"])


def _auc(df, col):
    return E.curve_metrics(E.threshold_table(E.scored_pairs(df, "label", col))).first()["roc_auc"]


def test_gbt_learns_planted_signal(spark):
    x = planted(spark)
    model = M.fit_gbt(x, "xgboost", max_iter=5)
    s = M.score_with(model, x, "p")
    st = s.agg(F.min("p"), F.max("p"), F.sum(F.col("p").isNull().cast("int"))).first()
    assert 0.0 <= st[0] and st[1] <= 1.0 and st[2] == 0
    assert _auc(s, "p") > 0.9
    imp = {r["feature"]: r["importance"] for r in M.feature_importance(model, ["x0", "x1"]).collect()}
    assert imp["x0"] > imp["x1"]


def test_anomaly_scores_bounded(spark):
    x = planted(spark)
    for model in (M.fit_isolation_forest(x, n_trees=20, rows_per_tree=64), M.fit_reconstruction(x, k=1)):
        st = model.score(x, out="s").agg(F.min("s"), F.max("s"), F.count("s")).first()
        assert 0.0 <= st[0] <= st[1] <= 1.0 and st[2] == 600


def test_oof_covers_every_row_and_isotonic_is_monotone(spark):
    x = planted(spark)
    oof = M.oof_scores(x, ["xgboost"], k=3, max_iter=3)
    assert oof.count() == 600 and oof.select("id").distinct().count() == 600
    iso = M.fit_isotonic(oof.withColumnRenamed("xgboost", "meta_score"))
    rows = iso.transform(oof.withColumnRenamed("xgboost", "meta_score")).select("meta_score", "_iso") \
        .orderBy("meta_score").collect()
    vals = [r["_iso"] for r in rows]
    assert all(a <= b + 1e-12 for a, b in zip(vals, vals[1:]))


def test_fits_of_all_folds_run_side_by_side(spark, monkeypatch):
    together = threading.Barrier(3, timeout=30)      # broken unless three fits have begun before one has ended

    def fit(kind, train, max_iter, seed, val=None):
        together.wait()
        return kind, train.where("fold is not null").count() if "fold" in train.columns else None

    monkeypatch.setattr(M, "_fit_base", fit)
    monkeypatch.setattr(M, "_score_base", lambda model, df, name, features: df.withColumn(name, F.lit(model[1])))
    oof = M.oof_scores(planted(spark), ["xgboost"], k=3)
    assert sorted(r["xgboost"] for r in oof.select("xgboost").distinct().collect()) and oof.count() == 600
    assert oof.where("xgboost < 390 or xgboost > 410").count() == 0      # each fold by the fit on the two others


def test_side_by_side_keeps_order_scope_and_errors(spark):
    with scratch.scratch_scope():
        frames = scratch.side_by_side(spark, [lambda n=n: scratch.materialise(spark.range(n), "side") for n in (3, 1, 2)])
        assert [f.count() for f in frames] == [3, 1, 2]
        assert len(scratch._SCOPE.written) == 3      # deleted with the caller's scope
    with pytest.raises(ZeroDivisionError):
        scratch.side_by_side(spark, [lambda: 1 / 0, lambda: 1])


def test_forest_input_holds_the_pool_only(spark, monkeypatch):
    written, write = {}, M.materialise

    def counted(df, name):
        out = write(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(M, "materialise", counted)
    M.fit_isolation_forest(planted(spark), n_trees=4, rows_per_tree=16)
    assert 0 < written["forest-input"] < 200      # about 4 * 16 of 600 rows


def test_forest_score_follows_every_path(spark):
    trees = pd.DataFrame([(0, 0, 0, 0.5, 1, 2, 5), (0, 1, -1, 0.0, -1, -1, 2), (0, 2, 1, 0.25, 3, 4, 3), (0, 3, -1, 0.0, -1, -1, 1),
                          (0, 4, -1, 0.0, -1, -1, 2), (1, 0, -1, 0.0, -1, -1, 5)], columns=["tree", "node", "feat", "split", "left", "right", "size"])
    x = [(1, 0.1, 0.9), (2, 0.5, 0.1), (3, 0.9, 0.25), (4, float("nan"), float("inf"))]
    df = M.assemble(spark.createDataFrame(x, "id long, a double, b double"), ["a", "b"])
    lone = M.unsuccessful_search(5)     # the second tree is one leaf
    length = {1: 1 + 1.0 + lone, 2: 2 + 0.0 + lone, 3: 2 + 1.0 + lone, 4: 2 + 1.0 + lone}
    got = M.IsolationForestModel(trees, 2, 5).raw_score(df, out="s").select("id", "s").collect()
    assert {r["id"]: r["s"] for r in got} == {i: pytest.approx(2 ** (-n / 2 / M.typical_path(5))) for i, n in length.items()}


def test_training_engineers_each_part_once_and_fits_the_drift_reference_beside_the_models(spark, monkeypatch):
    together = threading.Barrier(2, timeout=120)     # broken unless the two fits have begun before one has ended
    engineered, engineer, fit_reference = [], FE.engineer, T.D.fit_reference

    class Scores:
        names, oof_means = ["a"], {"a": 0.5}

        def score(self, x):
            return x.select("id", "label", *[(F.col("id") % 10 / 10.0).alias(c) for c in ("a", "meta_score", "score")])

    def fit_ensemble(train, val, *settings):
        together.wait()
        return Scores()

    def reference(x, cols):
        together.wait()
        return fit_reference(x, cols)

    monkeypatch.setattr(FE, "engineer", lambda df, *a, **k: engineered.append(df) or engineer(df, *a, **k))
    monkeypatch.setattr(T.M, "fit_ensemble", fit_ensemble)
    monkeypatch.setattr(T.D, "fit_reference", reference)
    apps = spark.range(100).select(
        "id", (F.col("id") % 3 == 0).cast("int").alias("label"), F.expr("date_add(DATE'2020-01-01', CAST(id AS INT))").alias("issue_d"),
        (F.col("id") * 10.0 + 1000).alias("loan_amnt"), F.lit(10.0).alias("int_rate"), F.lit(36.0).alias("term"),
        (F.col("id") * 100.0 + 20000).alias("annual_inc"), F.concat(F.lit("z"), F.col("id") % 7).alias("zip_code"),
        F.concat(F.lit("e"), F.col("id") % 5).alias("emp_title"), F.lit("A").alias("grade"))
    r = T.train(apps)
    assert len(engineered) == 3
    assert r.test_scores.count() == 15 and {x["model"] for x in r.report.collect()} == {"a", "ensemble"}
    assert r.sweep.count() == 99 and r.drift.expected.count() == r.drift.edges.count() * 10
    # the features of the training rows are those of a transform that engineers them itself
    train = T.P.time_split(T.labelled_frame(apps, T.TrainSettings())).where("split = 'train'").drop("split")
    eng, edges = FE.FeatureBuilder().engineer(train)
    fm = FE.FeatureBuilder().fit_engineered(eng, edges, "label")
    assert sorted(map(tuple, fm.transform(train).collect())) == sorted(map(tuple, fm.transform(eng, engineered=True).collect()))


def test_more_fits_run_at_once_when_the_rows_are_few(spark, monkeypatch):
    together = threading.Barrier(8, timeout=30)      # broken unless eight fits have begun before one has ended
    monkeypatch.setattr(M, "_fit_base", lambda kind, train, max_iter, seed, val=None: together.wait())
    monkeypatch.setattr(M, "_fold_scores", lambda folded, kinds, k, fitted: fitted)
    assert len(M.oof_scores(planted(spark), ["xgboost", "lightgbm"], k=4)) == 8
    monkeypatch.setattr(M, "FEW_ROWS", 599)
    assert M._at_once(planted(spark)) == M.MAX_AT_ONCE


def test_one_pca_is_fitted_at_a_time(spark, monkeypatch):
    x, held = planted(spark), []

    class Watched(M.PCA):
        def fit(self, df):
            held.append(M._ONE_PCA.locked())
            return super().fit(df)

    monkeypatch.setattr(M, "PCA", Watched)
    scratch.side_by_side(spark, [lambda: M.fit_reconstruction(x, k=1)] * 2)
    assert held == [True, True]


def test_boosted_trees_of_few_rows_are_fitted_in_few_tasks(spark, monkeypatch):
    x, seen = planted(spark).repartition(6), []

    class Watched(M.GBTClassifier):
        def fit(self, df):
            seen.append((df.rdd.getNumPartitions(), df.count()))

    monkeypatch.setattr(M, "GBTClassifier", Watched)
    monkeypatch.setattr(M, "ROWS_PER_TASK", 300)
    M._fit_base("xgboost", x, 2, 42)
    M._fit_base("xgboost", x, 2, 42, x.where("id < 100"))
    assert seen == [(2, 600), (3, 700)]         # every row, the validation rows with them
    seen.clear()
    M.fit_gbt(x, "xgboost", max_iter=2)
    assert seen[0][0] > 2                       # others keep their partitions


def test_forest_samples_are_those_of_the_hashes(spark):
    x = planted(spark, 300)
    got = M.fit_isolation_forest(x, n_trees=8, rows_per_tree=40, seed=7).trees
    span = 1 << 40
    for t in range(3):
        h = F.pmod(F.xxhash64(F.col("id"), F.lit(t), F.lit(7)), F.lit(span))
        rows = [r[0] for r in x.withColumn("_r", h).orderBy("_r", "id").limit(40).select(M.vector_to_array("features")).collect()]
        root = got[(got["tree"] == t) & (got["node"] == 0)].iloc[0]
        values = [r[int(root["feat"])] for r in rows]
        left = got[(got["tree"] == t) & (got["node"] == root["left"])].iloc[0]
        assert root["size"] == 40 and left["size"] == sum(v < root["split"] for v in values)


def wide(spark, n=400, d=60):
    cols = [F.sin(F.col("id") * (i + 1) * 0.37 + i).alias(f"x{i}") for i in range(d - 1)]
    df = spark.range(n).select("id", (F.col("id") % 9 == 0).cast("int").alias("label"), *cols, F.lit(3.0).alias(f"x{d - 1}"))
    return M.assemble(df, [f"x{i}" for i in range(d)])


def test_reconstruction_works_on_vectors_and_equals_its_definition(spark):
    x = wide(spark)
    model = M.fit_reconstruction(x, k=5)
    scored = model.raw_score(x, out="s")
    assert "[59]" not in scored._jdf.queryExecution().toString()        # no expression per element
    rows = scored.select("label", M.vector_to_array("features").alias("x"), "s").collect()
    a = np.array([r["x"] for r in rows])
    neg = a[[r["label"] == 0 for r in rows]]
    std = np.where(neg.std(axis=0) > 0, neg.std(axis=0), 1.0)
    assert np.allclose(model.mean, neg.mean(axis=0)) and np.allclose(model.std, std)
    z, zn = (a - neg.mean(axis=0)) / std, (neg - neg.mean(axis=0)) / std
    axes = np.linalg.eigh(np.cov(zn.T))[1][:, ::-1][:, :5]
    assert np.allclose([r["s"] for r in rows], ((z ** 2).sum(axis=1) - ((z @ axes) ** 2).sum(axis=1)) / 60, atol=1e-9)


def test_missing_values_keep_their_reconstruction_error(spark):
    x = planted(spark, 100)
    odd = M.assemble(x.select("id", F.when(F.col("id") == 7, F.lit(float("nan"))).otherwise(F.col("x0")).alias("x0"), "x1"), ["x0", "x1"])
    got = M.fit_reconstruction(x, k=1).raw_score(odd, out="s").where("s IS NULL OR isnan(s)").select("id", "s").collect()
    assert [r["id"] for r in got] == [7] and got[0]["s"] is not None


def test_calibration_rows_are_scored_once(spark, monkeypatch):
    seen, fit = [], M.fit_isotonic
    monkeypatch.setattr(M, "fit_isotonic", lambda rows: seen.append(rows) or fit(rows))
    x = planted(spark)
    M.fit_ensemble(x.where("id < 400"), x.where("id >= 400"), ["reconstruction"], k=2)
    assert hasattr(seen[0], "_scratch_path") and seen[0].count() == 200


def test_numeric_block_repeats_no_condition(spark):
    values = [(0, float("nan"), 1), (1, None, None), (2, float("inf"), 9), (3, float("-inf"), -9), (4, -0.0, 3), (5, 2.5, 4), (6, 7.0, 2)]
    df = spark.createDataFrame(values, "id int, a double, b int").withColumn("t", F.col("b").cast("string"))
    block = FE.numeric_block(df, ["a", "b", "t", "gone"], {"a": (0.0, 5.0), "b": (0.0, 3.0), "t": (0.0, 3.0)}, {"a": 1.5, "b": 2.0})
    out = df.select("id", *block).orderBy("id")
    assert [tuple(r)[1:] for r in out.collect()] == [
        (1.5, 1.0, 1.0, None), (1.5, 2.0, None, None), (5.0, 3.0, 3.0, None), (0.0, 0.0, 0.0, None), (0.0, 3.0, 3.0, None),
        (2.5, 3.0, 3.0, None), (5.0, 2.0, 2.0, None)]
    plan = df.select(FE.numeric_block(df, ["a"], {"a": (0.0, 5.0)}, {"a": 1.5})[0])._jdf.queryExecution().analyzed().toString()
    assert plan.count("isnan") == 1


def test_moments_come_from_a_few_columns_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(FE, "COLUMNS_AT_ONCE", 2)
    df = spark.range(50).select(*[(F.col("id") * (i + 1) % 17).cast("double").alias(f"c{i}") for i in range(5)]).withColumn(
        "c1", F.when(F.col("c1") > 3, F.col("c1")))
    got = FE._moments(df, df.columns, {c: (1.0, 15.0) for c in df.columns}, {c: 4.0 for c in df.columns})
    a = df.toPandas().clip(1.0, 15.0).fillna(4.0)
    assert list(got) == df.columns
    assert np.allclose([got[c] for c in df.columns], list(zip(a.mean(), a.std(ddof=0))))
