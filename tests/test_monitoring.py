"""Unique ids, time windows and drift on streams; CSV rejects, velocity index, resumable search."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from riskweave.operators import drift as D
from riskweave.operators import velocity as W
from riskweave.operators import velocity_index as VI
from riskweave.plans import search as SE
from riskweave.sources import io as IO
from riskweave.streaming import monitoring as MO
from riskweave.operators import ordering
from riskweave.sources.scratch import materialise, stored_columns

DAY = dt.datetime(2024, 1, 1)


def requests(spark, rows):
    return spark.createDataFrame([(i, None if d is None else DAY + dt.timedelta(days=d), note) for i, d, note in rows],
                                 "id long, ts timestamp_ntz, note string").coalesce(1)


def test_each_id_once_and_late_rows_listed(spark, tmp_path):
    src, sink, bad, state, progress = (str(tmp_path / x) for x in ("src", "sink", "bad", "state", "progress"))
    schema = requests(spark, [(1, 0, "a")]).schema
    deliveries = [
        [(1, 0, "a"), (2, 1, "b"), (2, 1, "b"), (3, 2, "late of two"), (3, 1.5, "first of two"), (None, 1, "x"), (9, None, "y")],
        [(1, 0, "a"), (2, 1, "b"), (4, 40, "d")],                # replayed rows
        [(5, 5, "too late"), (1, 41, "again after the delay"), (4, 39, "repeated")],
        [(6, 41, "f")]]
    for rows in deliveries:
        requests(spark, rows).write.mode("append").parquet(src)
        MO.unique_requests_stream(spark, src, schema, sink, bad, state, progress, "ts", "30 days", compact_every=2)
    got = sorted((r["id"], r["note"]) for r in spark.read.parquet(sink).collect())
    assert got == [(1, "a"), (1, "again after the delay"), (2, "b"), (3, "first of two"), (4, "d"), (6, "f")]
    out = sorted((r["id"] or "", r["reason"], r["epoch"]) for r in spark.read.parquet(bad).collect())
    assert out == [("", "no id", 0), ("1", "repeated", 1), ("2", "repeated", 0), ("2", "repeated", 1), ("3", "repeated", 0),
                   ("4", "repeated", 2), ("5", "late", 2), ("9", "no time", 0)]
    assert '"note":"too late"' in spark.read.parquet(bad).where("reason = 'late'").first()["request"]


def test_windows_equal_the_batch_report(spark, tmp_path):
    rng = random.Random(3)
    rows = [(DAY + dt.timedelta(hours=h), rng.choice(["one", "batch"]), rng.choice([0.0, 0.05, 0.3, 0.7, 1.0, rng.random()]), rng.gauss(h / 40, 1))
            for h in range(0, 120) for _ in range(4)]
    schema = "ts timestamp_ntz, endpoint string, score double, x double"
    frame = spark.createDataFrame(rows, schema)
    reference = D.fit_reference(spark.createDataFrame([(rng.gauss(0, 1),) for _ in range(300)], "x double"), ["x"])
    src = str(tmp_path / "src")
    for part in (frame.where("ts < timestamp_ntz'2024-01-03'"), frame.where("ts >= timestamp_ntz'2024-01-03'"),
                 spark.createDataFrame([(DAY + dt.timedelta(days=60), "end", 0.5, 0.0)], schema)):       # closes the windows before it
        part.write.mode("append").parquet(src)
        MO.decision_windows_stream(spark, src, schema, str(tmp_path / "d"), str(tmp_path / "dp"), "ts", "1 day", "2 days")
        MO.drift_windows_stream(spark, src, schema, reference, str(tmp_path / "f"), str(tmp_path / "fp"), "ts", "1 day", "2 days")
    # one more micro-batch lets the closed windows out
    spark.createDataFrame([(DAY + dt.timedelta(days=61), "end", 0.5, 0.0)], schema).write.mode("append").parquet(src)
    MO.decision_windows_stream(spark, src, schema, str(tmp_path / "d"), str(tmp_path / "dp"), "ts", "1 day", "2 days")
    MO.drift_windows_stream(spark, src, schema, reference, str(tmp_path / "f"), str(tmp_path / "fp"), "ts", "1 day", "2 days")
    early = F.col("window_start") < F.lit(DAY + dt.timedelta(days=5))
    a = sorted(map(tuple, spark.read.parquet(str(tmp_path / "d")).where(early).collect()))
    assert a == sorted(map(tuple, MO.decision_windows(frame, "ts", "1 day").collect())) and sum(r[-1] for r in a) == 480
    found = {(r["window_start"], r["feature"]): r["psi"] for r in MO.psi_by_window(spark.read.parquet(str(tmp_path / "f")).where(early), reference).collect()}
    assert len(found) == 5
    for (start, feature), value in found.items():
        whole = frame.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(start + dt.timedelta(days=1))))
        assert value == pytest.approx(reference.psi_report(whole).first()["psi"])


def test_every_line_is_accepted_or_rejected(spark, tmp_path):
    files = {"a.csv": 'id,title,zip_code\n1,"say ""hi"", you",900xx\n2,short\n\n3,"a,b",901xx,extra\n4,,\n',
             "b.csv": "zip_code,id,unknown\n902xx,5,z\n903xx\n904xx,6,z\n", "c.csv": "zip_code,title\n905xx,no id\n906xx,also\n", "d.csv": "id,id\n7,8\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got, bad = IO.read_csv_with_rejects(spark, str(tmp_path), ("id", "title", "zip_code", "grade"))
    assert got.columns == ["id", "title", "zip_code", "grade"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == [
        ("1", 'say "hi", you', "900xx", None), ("4", None, None, None), ("5", None, "902xx", None), ("6", None, "904xx", None)]
    assert sorted((r["file"].rsplit("/", 1)[1], r["reason"], r["line"]) for r in bad.collect()) == [
        ("a.csv", "fields", "2,short"), ("a.csv", "fields", '3,"a,b",901xx,extra'), ("b.csv", "fields", "903xx"),
        ("c.csv", "header", "905xx,no id"), ("c.csv", "header", "906xx,also"), ("d.csv", "header", "7,8")]
    assert got.count() == 4 and bad.count() == 6


def test_velocity_index_equals_brute_force_on_a_hot_key(spark, tmp_path):
    rng = random.Random(5)
    micros = 86_400_000_000
    events = [(i, "hot" if i % 3 else f"u{rng.randint(0, 5)}", DAY + dt.timedelta(microseconds=rng.choice([rng.randint(0, 100 * micros), 40 * micros, 90 * micros])))
              for i in range(600)] + [(600, None, DAY), (601, "hot", None)]
    cut = DAY + dt.timedelta(days=70)
    frame = spark.createDataFrame(events, "event_id long, user_id string, ts timestamp_ntz")
    new = (F.col("ts") >= F.lit(cut)) | F.col("ts").isNull()
    VI.build_index(frame.where(~new), "ts", ["user_id"], "event_id", part_rows=20).save(str(tmp_path / "i"))
    index = VI.VelocityIndex.load(spark, str(tmp_path / "i"))
    assert len(index.first) > 5                                  # the hot key spans many parts
    got = VI.build_velocity_with_index(frame.where(new), index, "ts", ["user_id"], (7, 30), "event_id", part_rows=15)
    rows = {r["event_id"]: (r["vel_user_id_7d"], r["vel_user_id_30d"]) for r in got.collect()}
    want = {}
    for i, u, t in events:
        if t is None or t >= cut:
            want[i] = tuple(sum(1 for j, v, s in events if u is not None and t is not None and v == u and s is not None and j != i
                                and t - dt.timedelta(days=w) <= s and (s < cut or (s, j) < (t, i)) and s <= t) for w in (7, 30))
    assert rows == want
    none = VI.build_index(frame.limit(0), "ts", ["user_id"], "event_id")
    assert VI.build_velocity_with_index(frame.limit(0), none, "ts", ["user_id"], (7,), "event_id").collect() == []


def test_search_resumes_and_times_out(spark, tmp_path):
    tried = []

    def objective(params):
        tried.append(params["maxDepth"])
        if len(tried) == 2:
            raise ValueError("broken")
        if len(tried) == 3:                                      # many jobs, each longer than the limit
            for _ in range(3):
                spark.range(2).repartition(2).mapInPandas(lambda b: (time.sleep(20) or x for x in b), "id long").count()
        return params["stepSize"]

    path = str(tmp_path / "trials")
    first = SE.search(spark, objective, path, 2, parallelism=1).collect()
    assert {(r["trial"], r["status"]) for r in first} == {(0, "done"), (1, "failed")} and first[0]["trial"] == 0
    begun = time.monotonic()
    rows = SE.search(spark, objective, path, 4, trial_seconds=1.5, parallelism=1).collect()
    assert time.monotonic() - begun < 45 and len(tried) == 4     # trials 0 and 1 are not repeated
    assert {r["trial"]: r["status"] for r in rows} == {0: "done", 1: "failed", 2: "timeout", 3: "done"}
    assert [r["pr_auc"] for r in rows][:2] == sorted((SE.trial_params(t)["stepSize"] for t in (0, 3)), reverse=True)
    assert SE.search(spark, objective, path, 6, total_seconds=0).count() == 4
    for r in SE.RANGES:
        values = [float(SE.trial_params(t)[r.name]) for t in range(50)]
        assert r.low <= min(values) and max(values) <= r.high and len(set(values)) > 5


def test_shares_of_many_columns_are_counted_in_place(spark, monkeypatch):
    cols = [f"c{i}" for i in range(9)]
    df = spark.range(300).select(*[(F.col("id") * (i + 3) % 41).cast("double").alias(c) for i, c in enumerate(cols)]).select(
        F.when(F.col("c0") > 30, float("inf")).when(F.col("c0") < 5, float("nan")).otherwise(F.col("c0")).alias("c0"),
        F.when(F.col("c1") > 7, F.col("c1")).alias("c1"), F.lit(2.0).alias("c2"), F.lit(None).cast("double").alias("c3"), *cols[4:])
    stored = materialise(df, "drift-test")
    want = {(r["feature"], r["bin"]): r["pct"] for r in
            D._shares(D._binned(D._long(stored, cols), D.fit_reference(stored, cols).edges)).collect()}
    monkeypatch.setattr(D, "_binned", None)             # no row per value
    monkeypatch.setattr(ordering, "materialise", None)  # the stored columns are not written again
    got = D.fit_reference(stored, cols, stored=True)
    assert {(r["feature"], r["bin"]): r["expected_pct"] for r in got.expected.collect()} == want
    again = D.fit_reference(stored_columns(stored, cols), cols)
    assert {(r["feature"], r["bin"]): r["expected_pct"] for r in again.expected.collect()} == want
    assert stored.count() == 300                        # and stay


def test_stored_columns_give_the_same_quantiles(spark):
    df = materialise(spark.range(500).select((F.col("id") * 37 % 101).cast("double").alias("a"), F.col("id").cast("double").alias("b")), "quantile-test")
    assert ordering.quantiles(df, ["a", "b"], [0.1, 0.5], stored=True) == ordering.quantiles(df, ["a", "b"], [0.1, 0.5])
    assert df.count() == 500
