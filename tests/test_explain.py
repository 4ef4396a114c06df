"""E11/E12 on features: parts add up to each model's score and to the margin."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskweave.plans import explain as EX
from riskweave.plans import models as M
from riskweave.plans import stages as ST


NAMES = [f"x{i}" for i in range(10)]


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(300).select("id", *[((F.col("id") * p % 101) / 101.0).alias(f"x{i}") for i, p in enumerate((7, 13, 29, 31, 37, 41, 43, 47, 53, 59))])
    df = df.withColumn("label", ((F.col("x0") > 0.7) | (F.col("x1") * F.col("x2") > 0.6)).cast("int"))
    return M.assemble(df, NAMES).repartition(2).cache()


@pytest.fixture(scope="module")
def ensemble(data):
    return M.fit_ensemble(data.where("id % 4 <> 0"), data.where("id % 4 = 0"), ["xgboost", "isolation_forest", "reconstruction"], k=2, max_iter=2)


def test_each_models_parts_add_up_to_its_score(data, ensemble):
    for name in ensemble.names:
        rows = M._score_base(ensemble.base[name], data, "s", "features").select(vector_to_array("features").alias("x"), "s").collect()
        x, s = np.array([r["x"] for r in rows]), np.array([r["s"] for r in rows])
        base, parts = EX.explainer_of(ensemble.base[name]).parts(x)
        assert np.abs(base + parts.sum(axis=1) - s).max() < 1e-9, name
        assert np.abs(parts).max() > 1e-3


def test_margin_is_the_meta_learners(data, ensemble):
    out = EX.margin_parts(ensemble.score(data), ensemble).withColumn("reason_codes", EX.reasons(NAMES, top_k=2))
    for r in out.select("base_margin", "margin", "parts", "meta_score", "reason_codes", vector_to_array("features").alias("x")).collect():
        assert abs(r["base_margin"] + sum(r["parts"]) - r["margin"]) < 1e-9
        assert abs(1 / (1 + np.exp(-r["margin"])) - r["meta_score"]) < 1e-9
        first = sorted(range(10), key=lambda i: (-abs(r["parts"][i]), i))[:2]
        assert [(c["feature"], c["value"], c["contribution"]) for c in r["reason_codes"]] == [(f"x{i}", r["x"][i], r["parts"][i]) for i in first]
        assert all(c["direction"] == ("up fraud" if c["contribution"] > 0 else "down fraud") for c in r["reason_codes"])
    top = EX.feature_importance(out, NAMES, top=2).collect()
    assert len(top) == 2 and top[0]["mean_abs_contribution"] >= top[1]["mean_abs_contribution"] > 0


def test_hand_made_tree():
    tree = EX.Tree(*map(np.array, ([0, -1, 1, -1, -1], [5.0, 0, 2.0, 0, 0], [1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [1.0, 0.0, 2.0, 1.5, 4.0])))
    base, parts = EX.path_parts(np.array([[5.0, 9.0], [6.0, 2.0], [6.0, 3.0]]), [tree], [2.0])
    assert base == 2.0 and parts.tolist() == [[-2.0, 0.0], [2.0, -1.0], [2.0, 4.0]]
    tree.equal_left = False
    assert EX.path_parts(np.array([[5.0, 2.0]]), [tree], [1.0])[1].tolist() == [[1.0, 2.0]]


def test_pipeline_of_stages_is_saved_and_loaded(spark, tmp_path):
    from riskweave.operators.labels import build_fraud_labels
    from riskweave.functions.normalize import installment
    from riskweave.sources.applications import applications
    apps = applications(spark, "/root/testdata/sf0.001").withColumn("installment", installment("loan_amnt", "int_rate", "term"))
    apps = build_fraud_labels(apps).withColumnRenamed("is_fraud", "label").withColumn("label", F.greatest("label", (F.col("id") % 7 == 0).cast("int")))
    model = ST.scoring_pipeline(kinds=["xgboost", "reconstruction"], rounds=2, folds=2, use_graph=False).fit(apps)
    model.write().overwrite().save(str(tmp_path / "p"))
    again = ST.load_pipeline(str(tmp_path / "p"))
    assert [type(s) for s in again.stages] == [type(s) for s in model.stages] and [s.uid for s in again.stages] == [s.uid for s in model.stages]
    a, b = ({r["id"]: r["score"] for r in m.transform(apps.drop("label").limit(80)).select("id", "score").collect()} for m in (model, again))
    assert a == b and len(a) == 80 and all(0 <= s <= 1 for s in a.values())


def test_scores_closer_than_four_decimals_calibrate_apart(spark):
    rows = [(i, 0.5 + i * 1e-6, int(i >= 50)) for i in range(100)]
    iso = M.fit_isotonic(spark.createDataFrame(rows, "id long, meta_score double, label int"))
    out = {r["id"]: r["_iso"] for r in iso.transform(spark.createDataFrame(rows, "id long, meta_score double, label int")).collect()}
    assert out[0] == out[49] == 0.0 and out[50] == out[99] == 1.0
