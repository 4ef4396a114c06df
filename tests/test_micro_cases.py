"""Hand-computed micro-cases for the semantic traps (FIXTURES.md section D, SURVEY section 8)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions import normalize as N
from riskweave.operators import behavior as B
from riskweave.operators import drift as D
from riskweave.operators import encode as E
from riskweave.operators import evaluate as EV
from riskweave.operators import graph as GR
from riskweave.operators import graph_state as GS
from riskweave.operators import ordering as G
from riskweave.operators import scoring as S
from riskweave.operators import velocity as W


def col_values(df, c, order="id"):
    return [r[c] for r in df.orderBy(order).select(c).collect()]


def test_percent_term_month_emp_parsers(spark):
    rows = [(1, "13.5%", " 36 months", "Dec-2015", "< 1 year"), (2, " 7%", "60", "dec-2015", "10+ years"),
            (3, "nan", "x", "2015-12", "3 years"), (4, "", None, None, "n/a"), (5, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, p string, t string, d string, e string")
    out = df.select("id", N.parse_percent("p").alias("p"), N.parse_term("t").alias("t"),
                    N.parse_month_year("d").alias("d"), N.parse_emp_length("e").alias("e")).orderBy("id").collect()
    assert [r["p"] for r in out] == [13.5, 7.0, None, None, None]
    assert [r["t"] for r in out][:3] == [36.0, 60.0, None]
    assert [str(r["d"]) for r in out][:3] == ["2015-12-01", "2015-12-01", "None"]
    assert [r["e"] for r in out] == [0.0, 10.0, 3.0, None, None]


def test_installment_zero_rate_is_null(spark):
    df = spark.createDataFrame([(10000.0, 12.0, 36.0), (1000.0, 0.0, 36.0)], "p double, r double, n double")
    got = [r[0] for r in df.select(N.installment("p", "r", "n")).collect()]
    r = 0.01
    assert got[0] == round(10000 * r / (1 - (1 + r) ** -36), 2)
    assert got[1] is None


def test_qcut_labels_and_constant(spark):
    vals = [1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id int, x double")
    edges = B.qcut_edges(G.quantiles(df, ["x"], B.DECILES)["x"])
    assert col_values(df.select("id", B.qcut_label("x", edges).alias("b")), "b") == [0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 8]
    const = spark.createDataFrame([(i, 5.0) for i in range(5)], "id int, x double")
    e2 = B.qcut_edges(G.quantiles(const, ["x"], B.DECILES)["x"])
    assert col_values(const.select("id", B.qcut_label("x", e2).alias("b")), "b") == [None] * 5


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=501)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.0, 0.005, 0.1, 0.5, 0.995, 1.0]
    got = G.quantiles(df, ["x"], probs)["x"]
    assert got == [round(float(v), 6) for v in np.quantile(x, probs)]


def test_global_index_is_exact(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id"))
    idx = G.indexed(df, ["k", "id"], "g", partitions=7).orderBy("g").collect()
    assert [r["g"] for r in idx] == list(range(1000))
    assert [r["k"] for r in idx] == sorted(r["k"] for r in idx)


def test_velocity_ties_by_id_and_peers(spark):
    rows = [(1, "a", "2020-01-01"), (2, "a", "2020-01-01"), (3, "a", "2020-01-01"), (4, "a", "2020-01-06"),
            (5, None, "2020-01-01"), (6, "a", None)]
    df = spark.createDataFrame(rows, "id long, k string, d string").withColumn("d", F.to_date("d"))
    w1 = W.build_velocity_features(df, "d", ["k"], [7])
    w2 = W.build_velocity_peers(df, "d", ["k"], [7])
    assert col_values(w1, "vel_k_7d") == [0, 1, 2, 3, 0, 0]
    assert col_values(w2, "velp_k_7d") == [2, 2, 2, 3, 0, 0]


def test_graph_two_shared_keys_link(spark):
    rows = [(1, "z1", "e1", "x1"), (2, "z1", "e1", "x2"), (3, "z2", "e2", "x3"), (4, "z2", "e9", "x4")]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    got = {r["id"]: (r["graph_component_size"], r["graph_degree"], r["graph_isolated"])
           for r in GR.graph_features(df, link_keys=("a", "b", "c")).collect()}
    assert got == {1: (2, 1, 0), 2: (2, 1, 0), 3: (1, 0, 1), 4: (1, 0, 1)}
    asked = df.where("id = 2").select("id")
    assert [tuple(r) for r in GR.links_of(df, asked, ("a", "b", "c")).collect()] == [(2, 1, 2)]


def test_a_batch_writes_its_keys_and_not_its_hubs(spark, monkeypatch):
    df = spark.range(200).select("id", *[F.lit(v).alias(v) for v in "abc"])
    written, write = [], GS.materialise

    def noted(frame, name):
        out = write(frame, name)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(GS, "materialise", noted)
    got = GS.link_batch(df, GS.empty_state(spark), ("a", "b", "c")).features
    assert [tuple(r)[1:] for r in got.distinct().collect()] == [(200, 199, 0)] * 200
    assert max(n for columns, n in written if "hub" in columns) == 4      # one row per hub, not per member


def test_links_of_asked_never_shuffle_pairs(spark):
    rows = [(1, "z", "e", "x"), (2, "z", "e", "x"), (3, "z", "e", None), (4, "z", None, "x"), (4, "z", None, "x"), (5, None, "e", "x"),
            (6, "z", None, None), (None, "z", "e", "x")]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    links = GR.links_of(df, df.where("id in (1, 4)").select("id"), ("a", "b", "c"))
    assert sorted(tuple(r) for r in links.collect()) == [(1, 2, 3), (1, 3, 2), (1, 4, 2), (1, 4, 2), (1, 5, 2),
                                                        (4, 1, 2), (4, 1, 2), (4, 2, 2), (4, 2, 2)]
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in line and "partner" in line for line in plan.splitlines())      # no distinct over pairs


def test_graph_degrees_match_brute_force_in_large_blocks(spark):
    rng = np.random.default_rng(11)
    # one block holds a third of the rows; nulls never link
    rows = [(i, "hot" if i % 3 == 0 else f"z{rng.integers(0, 4)}", None if i % 7 == 0 else f"e{rng.integers(0, 3)}",
             f"x{rng.integers(0, 3)}") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    want = {r[0]: sum(1 for o in rows if o[0] != r[0]
                      and sum(x is not None and x == y for x, y in zip(r[1:], o[1:])) >= 2) for r in rows}
    got = {r["id"]: r["graph_degree"] for r in GR.graph_features(df, link_keys=("a", "b", "c")).collect()}
    assert got == want and max(want.values()) > 20


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1, 2) for i in range(1, 40)] + [(100, 101, 2)], "src long, dst long, weight int")
    comp = {r["node"]: r["component"] for r in GR.components(edges).collect()}
    assert all(comp[i] == 1 for i in range(1, 41)) and comp[101] == 100
    assert GR.components.rounds < 20        # pointer jumping: far fewer rounds than the chain is long


def test_encoders_unknown_and_null(spark):
    train = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, None, 1), (4, "b", 0)], "id int, c string, y int")
    woe = E.fit_woe(train, ["c"], "y")
    te = E.fit_target(train, ["c"], "y")
    test = spark.createDataFrame([(1, "a"), (2, "zzz"), (3, None)], "id int, c string")
    w = {r["id"]: r["c_woe"] for r in woe.transform(test).collect()}
    t = {r["id"]: r["c_te"] for r in te.transform(test).collect()}
    assert w[2] == 0.0 and t[2] == pytest.approx(0.5)
    na_woe = math.log(((0 + .5) / (2 + .5)) / ((1 + .5) / (2 + .5)))
    assert w[3] == pytest.approx(na_woe)
    assert t[1] == pytest.approx((1 + 0.5 * 20) / (2 + 20))


def test_auc_ties_and_single_class(spark):
    tied = spark.createDataFrame([(i, i % 2, 0.4) for i in range(10)], "id long, label int, score double")
    assert EV.curve_metrics(EV.threshold_table(tied)).first()["roc_auc"] == pytest.approx(0.5)
    one = spark.createDataFrame([(i, 1, i / 10) for i in range(10)], "id long, label int, score double")
    assert EV.curve_metrics(EV.threshold_table(one)).first()["roc_auc"] is None


def test_auc_matches_pairwise_and_flip(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300), 2)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))],
                               "id long, label int, score double")
    pos, neg = s[y == 1], s[y == 0]
    pairwise = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    auc = EV.curve_metrics(EV.threshold_table(df)).first()["roc_auc"]
    flipped = EV.curve_metrics(EV.threshold_table(df.withColumn("score", 1 - F.col("score")))).first()["roc_auc"]
    assert auc == pytest.approx(pairwise) and flipped == pytest.approx(1 - pairwise)


def test_lift_top_row_and_cost_ties(spark):
    df = spark.createDataFrame([(i, 1 if i == 0 else 0, 1.0 - i / 10) for i in range(10)], "id long, label int, score double")
    assert EV.lift_at_k(df, 0.05) == pytest.approx(10.0)
    sweep = EV.cost_sweep(df)
    rows = sweep.collect()
    assert all(r["tp"] + r["fp"] + r["fn"] + r["tn"] == 10 for r in rows) and len(rows) == 99
    best = EV.optimal_threshold(sweep).first()
    least = min(r["total_cost"] for r in rows)
    assert best["total_cost"] == least
    assert best["threshold"] == min(r["threshold"] for r in rows if r["total_cost"] == least)


def test_decisions_and_histogram_edges(spark):
    df = spark.createDataFrame([(1, 0.3), (2, 0.7), (3, 0.2999999), (4, 1.0)], "id int, score double")
    got = col_values(df.select("id", S.decision("score").alias("d")), "d")
    assert got == ["REVIEW", "DECLINE", "APPROVE", "DECLINE"]
    bins = {r["bin"] for r in S.score_histogram(df.withColumn("label", F.lit(0))).collect()}
    assert 39 in bins


def test_psi_micro_and_identity(spark):
    exp = spark.createDataFrame([(5.0,)] * 4, "x double")
    act = spark.createDataFrame([(5.0,), (5.0,), (5.0,), (6.0,), (4.0,)], "x double")
    # all nine inner edges are 5, so values below 5 fall in the first bin and the rest in the last:
    # expected shares 0 (floored at 1e-6) and 1; actual shares 0.2 and 0.8; the empty bins cancel
    # (0.2 - 1e-6) ln 200000 + (0.8 - 1) ln 0.8
    assert D.psi(exp, act, "x") == pytest.approx(2.485831, abs=1e-6)
    same = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    assert D.psi(same, same, "x") == pytest.approx(0.0, abs=1e-12)


def test_velocity_with_history_snapshot(spark):
    hist = spark.createDataFrame([(1, "a", "2020-01-01"), (2, "a", "2020-01-01"), (3, "b", "2019-01-01")],
                                 "id long, k string, d string").withColumn("d", F.to_date("d"))
    batch = spark.createDataFrame([(10, "a", "2020-01-06"), (11, "a", "2020-01-06"), (12, "a", "2020-03-01")],
                                  "id long, k string, d string").withColumn("d", F.to_date("d"))
    state = W.velocity_state(hist, "d", ["k"])
    out = W.build_velocity_with_history(batch, state, "d", ["k"], [7])
    assert col_values(out, "vel_k_7d") == [2, 3, 0]


def test_refinement_order_statistics_many_passes(spark):
    rng = np.random.default_rng(7)
    # heavy tail, many repeats and a constant block: refinement must stay exact
    x = np.concatenate([rng.lognormal(0, 2, 3000), np.full(500, 3.25), rng.integers(0, 5, 1000).astype(float)])
    df = spark.createDataFrame([(0, float(v)) for v in x], "f int, v double")
    ranks = [0, 1, 17, 999, 2500, 3499, 3500, 4498, 4499]
    got = G._order_stats_refine(df, {0: set(ranks)}, buckets=8, max_passes=60)
    srt = np.sort(x)
    assert {k: got[(0, k)] for k in ranks} == {k: float(srt[k]) for k in ranks}
    probs = [0.0, 0.005, 0.1, 0.5, 0.995, 1.0]
    df2 = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert G.quantiles(df2, ["x"], probs)["x"] == [round(float(v), 6) for v in np.quantile(x, probs)]
    assert G.quantiles(df2, ["x"], probs, method="sort")["x"] == G.quantiles(df2, ["x"], probs)["x"]


def test_later_quantile_passes_unpivot_open_intervals_only(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") * 0.37).alias("a"), F.when(F.col("id") % 3 > 0, F.sqrt("id")).alias("b"), F.lit(2.0).alias("c"))
    seen, within = [], G._within

    def counted(*args):
        seen.append(within(*args).count())
        return within(*args)

    monkeypatch.setattr(G, "_within", counted)
    got = G.quantiles(df, ["a", "b", "c"], [0.25, 0.5])
    want = df.toPandas().quantile([0.25, 0.5])
    for c in "abc":
        assert got[c] == pytest.approx(want[c].tolist(), abs=1e-6)
    assert seen[0] <= 5000 + 3333 and len(seen) > 1 and max(seen[1:]) < 200


def test_history_state_knows_its_keys_by_name(spark):
    hist = spark.createDataFrame([(1, "x", "2020-01-01")], "id long, addr_state string, d string").withColumn("d", F.to_date("d"))
    batch = spark.createDataFrame([(9, "x", "x", "2020-01-02")], "id long, emp_title string, addr_state string, d string") \
        .withColumn("d", F.to_date("d"))
    keys = ["emp_title", "addr_state"]
    out = W.build_velocity_with_history(batch, W.velocity_state(hist, "d", keys), "d", keys, [7]).first()
    assert (out["vel_emp_title_7d"], out["vel_addr_state_7d"]) == (0, 1)


def test_fine_grained_velocity_on_a_hot_key(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "hot" if i % 3 == 0 else f"u{i % 11}", int(rng.integers(0, 40))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, h int").withColumn(
        "ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h, 0, 0)"))
    w1 = {r["id"]: r["vel_k_1d"] for r in W.build_velocity_features(df, "ts", ["k"], [1], unit="micros").collect()}
    w2 = {r["id"]: r["velp_k_1d"] for r in W.build_velocity_peers(df, "ts", ["k"], [1], unit="micros").collect()}
    for i, k, h in rows:
        near = [(j, g) for j, kk, g in rows if kk == k and j != i and h - 24 <= g <= h]
        assert w1[i] == sum(1 for j, g in near if g < h or j < i) and w2[i] == len(near)


def test_missing_scores_say_nothing(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.1), (3, 1, None)], "id long, label int, score double")
    known = df.where("score IS NOT NULL")
    assert EV.pointwise_metrics(df).first() == EV.pointwise_metrics(known).first()
    assert sorted(tuple(r) for r in S.score_histogram(df).collect()) == sorted(tuple(r) for r in S.score_histogram(known).collect())
    assert EV.cost_sweep(df).collect() == EV.cost_sweep(known).collect()


def test_threshold_is_compared_with_the_score_as_it_is(spark):
    df = spark.createDataFrame([(1, 1, 0.4999996), (2, 0, 0.5)], "id long, label int, score double")
    assert EV.loss_avoidance(df, 0.5).first()["frauds_caught"] == 0
    row = {round(r["threshold"], 2): r for r in EV.cost_sweep(df).collect()}[0.5]
    assert (row["tp"], row["fp"]) == (0, 1)


def test_many_groups_and_a_hot_one_in_prefix_sums(spark):
    df = spark.range(0, 6000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 1500).alias("g"),
                                     F.col("id").alias("o"), F.lit(1.0).alias("c"))
    got = EV.prefix_sums(df, ["g"], [F.col("o")], ["o"], ["c"], partitions=7)
    w = got.groupBy("g").agg(F.max("cum_c").alias("m"), F.sum("c").alias("n"), F.countDistinct("cum_c").alias("d")).collect()
    assert all(r["m"] == r["n"] == r["d"] for r in w) and max(r["n"] for r in w) == 2000


def test_infinite_values_keep_quantiles_exact(spark):
    x = [float("-inf"), 1.0, 2.0, 3.0, 1e308, -1e308, float("inf")]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    assert G.quantiles(df, ["x"], [0.0, 0.5, 1.0])["x"] == [float("-inf"), 2.0, float("inf")]


def test_validation_reports_text_and_repeated_ids(spark):
    from riskweave.operators import validate as V
    df = spark.createDataFrame([(1, "abc"), (2, "100"), (2, "900"), (3, None)], "id long, loan_amnt string")
    rules = [r for r in V.LOAN_RULES if r.column in ("id", "loan_amnt")]
    got = sorted((r["id"], r["column"], r["check"]) for r in V.validation_report(df, rules).collect())
    assert got == [(1, "loan_amnt", "type_double"), (2, "id", "unique"), (2, "id", "unique"), (2, "loan_amnt", "ge")]


def test_psi_of_long_rows_equals_wide(spark):
    rng = np.random.default_rng(2)
    e, a = rng.normal(0, 1, 500).round(2), rng.normal(0.4, 1, 400).round(2)
    wide = D.psi(spark.createDataFrame([(float(v),) for v in e], "f double"), spark.createDataFrame([(float(v),) for v in a], "f double"), "f")
    long = D.psi_of_long(spark.createDataFrame([("f", float(v)) for v in e], "feature string, x double"),
                         spark.createDataFrame([("f", float(v)) for v in a], "feature string, x double")).first()
    assert long["psi"] == pytest.approx(wide, rel=1e-9)


def test_lift_cuts_among_ties_by_id(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(0, 2)), float(rng.integers(0, 4)) / 4) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    top = sorted(rows, key=lambda r: (-r[2], r[0]))
    for k in (0.05, 0.1, 0.5, 1.0):
        n = max(int(100 * k), 1)
        want = (sum(r[1] for r in top[:n]) / n) / (sum(r[1] for r in rows) / 100)
        assert EV.lift_at_k(df, k) == pytest.approx(want)


def test_quantiles_of_many_columns_count_without_unpivoting(spark, monkeypatch):
    rng = np.random.default_rng(5)
    shapes = [rng.normal(size=3000), np.round(rng.normal(size=3000), 1), np.zeros(3000), rng.lognormal(0, 9, 3000),
              np.where(np.arange(3000) % 3 == 0, 7.0, rng.uniform(-1e300, 1e300, 3000)), np.where(np.arange(3000) % 5 == 0, -np.inf, rng.normal(size=3000)),
              np.where(np.arange(3000) % 4 == 0, np.nan, rng.integers(0, 9, 3000)), np.full(3000, np.inf), np.full(3000, np.nan)]
    cols = [f"x{i}" for i in range(len(shapes))]
    rows = [tuple(None if k % 50 == 0 else float(v) for v in row) for k, row in enumerate(zip(*shapes))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    probs = [0.0, 0.005, 0.25, 0.5, 0.9, 0.995, 1.0]
    monkeypatch.setattr(G, "MANY_COLUMNS", len(cols) + 1)
    unpivoted = G.quantiles(df, cols, probs, points=True)
    monkeypatch.setattr(G, "MANY_COLUMNS", len(cols))
    monkeypatch.setattr(G, "_within", None)     # not called
    assert G.quantiles(df, cols, probs, points=True) == unpivoted
    known = np.array([r[1] for r in rows if r[1] is not None])
    assert G.quantiles(df, cols, probs)["x1"] == [round(float(v), 6) for v in np.quantile(known, probs)]
    assert G.quantiles(df, cols, probs)["x8"] == [None] * len(probs)
