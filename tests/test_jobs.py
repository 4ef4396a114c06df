"""Streaming restarts, training on the user's own file, persistence, the request gate."""

import pytest
from pyspark.sql import functions as F

from riskweave.operators import labels as L
from riskweave.plans import models as M
from riskweave.plans import training as T
from riskweave.sources import io as IO
from riskweave.streaming import scoring as ST


def test_restarted_stream_scores_every_row_once(spark, tmp_path):
    src, sink, progress = (str(tmp_path / x) for x in ("src", "sink", "progress"))
    for batch in range(3):
        rows = spark.range(batch * 10, batch * 10 + 10).select("id", (F.col("id") / 30.0).alias("score"))
        rows.coalesce(1).write.mode("append").parquet(src)
        ST.banding_stream(spark, src, rows.schema, sink, progress)          # stops; the next round starts it again
    got = spark.read.parquet(sink)
    assert sorted(r["id"] for r in got.collect()) == list(range(30))
    assert got.select("epoch").distinct().count() == 3


def test_a_repeated_epoch_replaces_its_own_rows(spark, tmp_path):
    sink = str(tmp_path / "sink")
    for n in (4, 6):
        ST.write_epoch(spark.range(n), sink, 0)
    ST.write_epoch(spark.range(100, 102), sink, 1)
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == [0, 1, 2, 3, 4, 5, 100, 101]


def test_running_totals_survive_a_restart(spark, tmp_path):
    src, sink, progress = (str(tmp_path / x) for x in ("src", "sink", "progress"))
    for batch in range(2):
        spark.range(10).select("id", F.lit(0.9 if batch else 0.1).alias("score")).write.mode("append").parquet(src)
        ST.decision_count_stream(spark, src, "id long, score double", sink, progress)
    assert {r["decision"]: r["n"] for r in spark.read.parquet(f"{sink}/totals").collect()} == {"APPROVE": 10, "DECLINE": 10}


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    """A raw export written as CSV (quotes and commas inside a field), read, labelled, split and trained on."""
    from riskweave.sources.applications import raw_applications
    raw = raw_applications(spark, "/root/testdata/sf0.001").withColumn("title", F.concat(F.lit('say "hi", '), F.coalesce("title", F.lit(""))))
    path = IO.write_csv(raw, str(tmp_path_factory.mktemp("csv") / "raw"))
    apps = T.applications_from_csv(spark, path)
    settings = T.TrainSettings(split="stratified", kinds=("xgboost", "isolation_forest", "reconstruction"), rounds=2, folds=2,
                               labels=L.LabelRules({"first_payment_default": {"days": 90}}), use_graph=False)
    return apps, T.train(apps, settings)


def test_training_from_a_raw_file(trained):
    apps, result = trained
    types = dict(apps.dtypes)
    assert types["id"] == "bigint" and types["loan_amnt"] == types["annual_inc"] == "double" and types["issue_d"] == "date"
    assert apps.where("title LIKE 'say \"hi\",%'").count() == apps.count()
    models = {r["model"] for r in result.report.collect()}
    assert models == {"xgboost", "isolation_forest", "reconstruction", "ensemble"}
    assert set(result.meta_means) == models - {"ensemble"}
    scores = result.test_scores
    assert scores.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert scores.count() == scores.select("id").distinct().count()


def test_saved_job_scores_alike(spark, trained, tmp_path):
    apps, result = trained
    result.save(str(tmp_path / "job"))
    again = T.TrainingResult.load(spark, str(tmp_path / "job"))
    req = apps.limit(50)
    a, b = ({r["application_id"]: (r["fraud_score"], r["decision"]) for r in T.score_batch(x, req, "2024-01-01 00:00:00").collect()}
            for x in (result, again))
    assert a == b and len(a) == 50
    assert again.drift.expected.count() == result.drift.expected.count()


def test_gate_quarantines_what_breaks_the_contract(spark, trained, tmp_path):
    apps, result = trained
    good = apps.withColumn("sub_grade", F.lit("A1")).withColumn("home_ownership", F.lit("RENT")) \
        .withColumn("installment", F.lit(100.0)).withColumn("emp_length", F.lit(3.0)) \
        .withColumn("loan_amnt", F.lit(9000.0)).withColumn("annual_inc", F.lit(50000.0)).withColumn("dti", F.lit(10.0)) \
        .withColumn("revol_bal", F.lit(1.0)).limit(10)
    rows = good.withColumn("issue_d", F.lit("not-a-date"))
    bad = rows.limit(1).withColumn("id", F.lit(-1).cast("long")).withColumn("loan_amnt", F.lit(1.0))
    out = T.score_batch(result, rows.unionByName(bad), "2024-01-01 00:00:00", quarantine_dir=str(tmp_path / "q"))
    broken = spark.read.parquet(str(tmp_path / "q"))
    assert [(r["id"], r["column"], r["check"]) for r in broken.where("id = -1").collect()] == [(-1, "loan_amnt", "ge")]
    scored = {r["application_id"] for r in out.collect()}
    assert -1 not in scored and scored | {r["id"] for r in broken.collect()} == {r["id"] for r in rows.collect()} | {-1}


def test_scoring_stream_keeps_its_history_and_quarantines_per_epoch(spark, trained, tmp_path):
    """Two deliveries, each with a broken request: scores against all accepted requests, rejected ones whole and per epoch."""
    import dataclasses
    apps, result = trained
    linked = dataclasses.replace(result, features=dataclasses.replace(result.features, use_graph=True, link_keys=("zip_code", "emp_title")))
    req = apps.withColumn("sub_grade", F.lit("A1")).withColumn("home_ownership", F.lit("RENT")).withColumn("installment", F.lit(100.0)) \
        .withColumn("emp_length", F.lit(3.0)).withColumn("loan_amnt", F.when(F.col("id") % 3 == 0, 1.0).otherwise(9000.0)) \
        .withColumn("annual_inc", F.lit(50000.0)).withColumn("dti", F.lit(10.0)).withColumn("revol_bal", F.lit(1.0)) \
        .withColumn("emp_title", F.lit("clerk")).orderBy("id").limit(20).cache()
    src, sink, bad, state, progress = (str(tmp_path / x) for x in ("src", "sink", "bad", "state", "progress"))
    ids = [r["id"] for r in req.select("id").collect()]
    for part in (ids[:10], ids[10:]):
        req.where(F.col("id").isin(part)).coalesce(1).write.mode("append").parquet(src)
        ST.model_scoring_stream(spark, src, req.schema, linked, "2024-01-01 00:00:00", sink, progress, state_dir=state, quarantine_dir=bad)
    scored = {r["application_id"]: len(r["reason_codes"]) for r in spark.read.parquet(sink).collect()}
    broken = spark.read.parquet(bad).collect()
    assert {r["epoch"] for r in broken} == {0, 1} and all('"loan_amnt":1.0' in r["request"] for r in broken if r["column"] == "loan_amnt")
    assert set(scored) | {r["id"] for r in broken} == set(ids) and not set(scored) & {r["id"] for r in broken} and set(scored.values()) == {5}
    history = ST.RequestHistory(spark, state)
    assert history.sizes.before(2).agg(F.sum("rows")).first()[0] == len(scored)
    assert history.days.before(2).where("k = 'emp_title'").agg(F.sum("n_day")).first()[0] == \
        req.where(F.col("id").isin(list(scored)) & F.col("issue_d").isNotNull()).count()


def test_isolation_forest_takes_distinct_rows_whatever_the_partitioning(spark):
    df = M.assemble(spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")), ["a", "b"])
    one, many = (M.fit_isolation_forest(df.repartition(p), n_trees=5, rows_per_tree=40).trees for p in (1, 6))
    assert one.sort_values(["tree", "node"]).reset_index(drop=True).equals(many.sort_values(["tree", "node"]).reset_index(drop=True))
    assert (one[one["node"] == 0]["size"] == 40).all()
    with pytest.raises(ValueError):
        M.fit_isolation_forest(df, rows_per_tree=0.5)
