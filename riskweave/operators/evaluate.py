"""Metrics over scored pairs ``(id, label, score)``.

Everything starts from the threshold table T: one pre-aggregation by score
(``pos``, ``neg`` per distinct score; partial aggregation map-side), then the
descending cumulative ``tp``/``fp``. The cumulative sum is a distributed
prefix sum (``prefix_sums``): T is range-partitioned and sorted by the order
key, the totals of the earlier partitions give a piece
its carry-in, and a native window over (partition, group) adds the running
sum. No step pulls T, which may have one row per input row, into one task.

E1 ROC-AUC (ties count 1/2), E2 step-wise average precision, E3 KS and Gini,
E4 recall at an FPR target, E5 top-k lift (ties by id), E6 log loss / Brier,
E7 the 99-threshold cost sweep (rows bucketed by threshold index; a 100-row
accumulation instead of 99 scans), E8 optimal threshold, E9 loss avoidance,
E10 group report.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffle_partitions
from .ordering import rows_at


def prefix_sums(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column], order_names: Sequence[str],
                sum_cols: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` within each group, in ``order_cols`` order.

    ``df`` must already hold the ordering keys as columns named ``order_names``
    (``order_cols`` are the sort expressions over them, e.g. ``desc``).
    Output columns ``cum_<c>`` are added; every other column is kept.

    Plan: range-partition by (group, order) and checkpoint, so a hot group is
    spread over many partitions; the running sum of a group's totals over earlier
    partitions is each piece's carry-in; the running sum inside a piece is a
    native window over (partition, group), whose size is bounded by the range partition.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n_parts = partitions or shuffle_partitions(spark)
    keys = [F.col(g) for g in group_cols] + list(order_cols)
    ranged = (df.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    # carry-in of a piece: what its group has in earlier partitions. Only groups that
    # straddle partitions have any, so their number is below the number of partitions,
    # however many groups there are.
    totals = ranged.groupBy("_pid", *group_cols).agg(*[F.sum(F.col(c).cast("double")).alias(f"_t_{c}") for c in sum_cols])
    earlier = (Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select("_pid", *group_cols, F.count(F.lit(1)).over(earlier).alias("_pieces"),
                          *[F.sum(f"_t_{c}").over(earlier).alias(f"_carry_{c}") for c in sum_cols])
    carry = carry.where("_pieces > 0").drop("_pieces")
    w = (Window.partitionBy("_pid", *group_cols).orderBy(*order_cols)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    keep = [f"_g_{g}" for g in group_cols]
    carry = carry.select(F.col("_pid").alias("_cpid"), *[F.col(g).alias(k) for g, k in zip(group_cols, keep)],
                         *[f"_carry_{c}" for c in sum_cols])
    same = F.col("_pid") == F.col("_cpid")
    for g, k in zip(group_cols, keep):
        same = same & F.col(g).eqNullSafe(F.col(k))
    # at most one row per partition: broadcast
    out = ranged.join(F.broadcast(carry), same, "left").drop("_cpid", *keep)
    for c in sum_cols:
        out = out.withColumn(f"cum_{c}", F.sum(F.col(c).cast("double")).over(w)
                             + F.coalesce(F.col(f"_carry_{c}"), F.lit(0.0)))
    return out.drop("_pid", *[f"_carry_{c}" for c in sum_cols])


def scored_pairs(df: DataFrame, label: str = "label", score: str = "score", key: str = "id") -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label"),
                     F.col(score).cast("double").alias("score"))


def threshold_table(pairs: DataFrame, group_col: str | None = None) -> DataFrame:
    """T: per (group,) score: pos, neg, and descending cumulative tp, fp (inclusive). Rows without a score say nothing."""
    g = [group_col] if group_col else []
    t = pairs.where(F.col("score").isNotNull() & F.col("label").isNotNull()).groupBy(*g, "score").agg(F.sum("label").cast("double").alias("pos"),
                                       F.sum(1 - F.col("label")).cast("double").alias("neg"))
    cum = prefix_sums(t, g, [F.col("score").desc()], ["score"], ["pos", "neg"])
    return cum.withColumnRenamed("cum_pos", "tp").withColumnRenamed("cum_neg", "fp")


def curve_metrics(t: DataFrame, fpr_target: float = 0.05, group_col: str | None = None) -> DataFrame:
    """E1-E4 over T (per group when given): roc_auc, pr_auc, ks, gini, recall_at_fpr."""
    g = [group_col] if group_col else []
    totals = t.groupBy(*g).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if g:
        tt = t.join(totals, g, "inner")
    else:   # two scalars: inline them
        tot = totals.first()
        tt = t.withColumn("P", F.lit(float(tot["P"] or 0.0))).withColumn("N", F.lit(float(tot["N"] or 0.0)))
    auc = F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)), F.first("P") * F.first("N"))
    ap = F.try_divide(F.sum(F.col("pos") * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))), F.first("P"))
    tpr = F.try_divide(F.col("tp"), F.col("P"))
    fpr = F.try_divide(F.col("fp"), F.col("N"))
    ks = F.greatest(F.max(tpr - fpr), F.lit(0.0))
    rec = F.coalesce(F.max(F.when(fpr <= fpr_target, tpr)), F.lit(0.0))
    both = (F.first("P") > 0) & (F.first("N") > 0)
    out = tt.groupBy(*g).agg(F.when(both, auc).alias("roc_auc"), F.when(both, ap).alias("pr_auc"),
                             F.when(both, ks).alias("ks"), F.when(both, rec).alias("recall_at_fpr"))
    return out.withColumn("gini", 2 * F.col("roc_auc") - 1)


def pointwise_metrics(pairs: DataFrame) -> DataFrame:
    """N, positive rate, log loss (scores clipped to [1e-7, 1-1e-7]) and Brier score of the rows that have a score."""
    p = F.least(F.greatest(F.col("score"), F.lit(1e-7)), F.lit(1 - 1e-7))
    y = F.col("label").cast("double")
    return pairs.where(F.col("score").isNotNull() & y.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("positive_rate"),
                     F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"),
                     F.avg((F.col("score") - y) ** 2).alias("brier"))


def lift_at_k(pairs: DataFrame, top_k: float, t: DataFrame | None = None) -> float | None:
    """E5: positive rate of the top max(int(n*k), 1) rows (score desc, id asc) over the base rate.

    The boundary is read from the threshold table ``t``; only the rows that tie at the
    boundary score are ordered by id, and only when the cut falls among them.
    """
    pairs = pairs.where(F.col("score").isNotNull() & F.col("label").isNotNull())
    t = threshold_table(pairs) if t is None else t
    total = t.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    if not total["P"] and not total["N"]:
        return None
    n = int(total["P"] + total["N"])
    n_top = max(int(n * top_k), 1)
    edge = t.where(F.col("tp") + F.col("fp") >= n_top).agg(F.max(F.struct("score", "pos", "neg", "tp", "fp")).alias("e")).first()["e"]
    above = int(edge["tp"] + edge["fp"] - edge["pos"] - edge["neg"])
    hits, left = edge["tp"] - edge["pos"], n_top - above
    tied = pairs.where(F.col("score") == F.lit(edge["score"]))
    if left == int(edge["pos"] + edge["neg"]):
        hits += edge["pos"]
    else:
        last = rows_at(tied.select("id"), ["id"], [left - 1])[0]["id"]
        hits += tied.where(F.col("id") <= F.lit(last)).agg(F.sum("label").alias("h")).first()["h"] or 0
    return (hits / n_top) / max(total["P"] / n, 1e-9)


def binary_metrics(pairs: DataFrame, fpr_target: float = 0.05) -> DataFrame:
    """E1-E6 in one row (metric names as the reference builds them)."""
    t = threshold_table(pairs)
    curve = curve_metrics(t, fpr_target).first()
    point = pointwise_metrics(pairs).first()
    spark = pairs.sparkSession
    row = {"roc_auc": curve["roc_auc"], "pr_auc": curve["pr_auc"], "ks": curve["ks"], "gini": curve["gini"],
           "log_loss": point["log_loss"], "brier": point["brier"],
           f"recall_at_fpr_{int(fpr_target * 100)}pct": curve["recall_at_fpr"],
           "lift_top_5pct": lift_at_k(pairs, 0.05, t), "lift_top_10pct": lift_at_k(pairs, 0.1, t),
           "n": float(point["n"]), "positive_rate": point["positive_rate"]}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))


# ---------------------------------------------------------------- E7-E9: cost

# Default cost matrix.
COST_FN, COST_FP, COST_TP, COST_TN = 1200.0, 20.0, 0.0, 0.0
N_THRESHOLDS = 99


def threshold_index(score: Column, n: int = N_THRESHOLDS) -> Column:
    """Number of thresholds t_i = i/100 (i = 1..n) with score >= t_i (the score as it is)."""
    s = score
    b = F.floor(s * 100).cast("int")
    b = F.when((b + 1) / F.lit(100.0) <= s, b + 1).otherwise(b)
    b = F.when(b / F.lit(100.0) > s, b - 1).otherwise(b)
    return F.least(F.greatest(b, F.lit(0)), F.lit(n))


def cost_sweep(pairs: DataFrame, fn: float = COST_FN, fp: float = COST_FP, tp: float = COST_TP,
               tn: float = COST_TN) -> DataFrame:
    """Per threshold i/100: tp, fp, fn, tn, review rate, recall, precision, total and per-applicant cost."""
    spark = pairs.sparkSession
    pairs = pairs.where(F.col("score").isNotNull() & F.col("label").isNotNull())
    per_bucket = (pairs.groupBy(threshold_index(F.col("score")).alias("b"))
                  .agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")))
    # tp(t_i) = positives with bucket >= i: a running sum from the top over the
    # 100 buckets (a bounded table; the window runs in one small task)
    grid = spark.range(0, N_THRESHOLDS + 1).select(F.col("id").cast("int").alias("b"))
    from_top = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    agg = (grid.join(F.broadcast(per_bucket), "b", "left").fillna(0, subset=["pos", "neg"])
           .select(F.col("b").alias("i"), F.sum("pos").over(from_top).alias("tp"),
                   F.sum("neg").over(from_top).alias("fp"))
           .where(F.col("i") >= 1))
    tot = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("P")).first()
    n, P = tot["n"], tot["P"] or 0
    c_tp, c_fp = F.col("tp").cast("long"), F.col("fp").cast("long")
    c_fn, c_tn = F.lit(P) - c_tp, F.lit(n - P) - c_fp
    total = c_fn * fn + c_fp * fp + c_tp * tp + c_tn * tn
    return agg.select((F.col("i") / F.lit(100.0)).alias("threshold"),
                      ((c_tp + c_fp) / F.lit(float(n))).alias("review_rate"),
                      c_tp.alias("tp"), c_fp.alias("fp"), c_fn.alias("fn"), c_tn.alias("tn"),
                      (c_tp / F.lit(float(max(P, 1)))).alias("recall"),
                      (c_tp / F.greatest(c_tp + c_fp, F.lit(1))).alias("precision"),
                      total.cast("double").alias("total_cost"), (total / F.lit(float(n))).alias("cost_per_applicant"))


def optimal_threshold(sweep: DataFrame) -> DataFrame:
    """The lowest threshold among those with minimal total cost (a 99-row table)."""
    return sweep.orderBy("total_cost", "threshold").limit(1).select("threshold", "total_cost")


def loss_avoidance(pairs: DataFrame, threshold: float, avg_fraud_loss: float = 1200.0, review_cost: float = 20.0,
                   baseline_recall: float = 0.0) -> DataFrame:
    """Frauds caught, false alarms, gross savings vs a baseline recall, review cost, net savings."""
    flagged = F.col("score") >= F.lit(threshold)
    a = pairs.where(F.col("score").isNotNull() & F.col("label").isNotNull()).agg(F.sum(F.when(flagged & (F.col("label") == 1), 1).otherwise(0)).cast("long").alias("frauds_caught"),
                  F.sum(F.when(flagged & (F.col("label") == 0), 1).otherwise(0)).cast("long").alias("false_alarms"),
                  F.sum("label").cast("double").alias("_pos"))
    caught = F.col("frauds_caught") * avg_fraud_loss
    base = F.lit(baseline_recall) * F.col("_pos") * avg_fraud_loss
    review = (F.col("frauds_caught") + F.col("false_alarms")) * review_cost
    return a.select("frauds_caught", "false_alarms", (caught - base).cast("double").alias("gross_savings"),
                    review.cast("double").alias("review_cost"), (caught - base - review).cast("double").alias("net_savings"))


# ---------------------------------------------------------------- E10: groups

def group_report(pairs: DataFrame, group_col: str, threshold: float = 0.5, min_group_size: int = 200) -> DataFrame:
    """Per group with n >= min size and both classes: n, positive rate, auc, auc_gap,
    tpr, fpr, fpr_gap, approval rate; NULL group dropped; sorted by auc_gap."""
    pairs = pairs.where(F.col("score").isNotNull() & F.col("label").isNotNull())
    overall_auc = curve_metrics(threshold_table(pairs)).first()["roc_auc"]
    pred = (F.col("score") >= F.lit(threshold)).cast("int")
    o = pairs.agg(F.sum(F.when((pred == 1) & (F.col("label") == 0), 1).otherwise(0)).alias("fp"),
                  F.sum(1 - F.col("label")).alias("neg")).first()
    overall_fpr = (o["fp"] or 0) / max(o["neg"] or 0, 1)
    gp = pairs.where(F.col(group_col).isNotNull())
    stats = gp.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n"), F.avg("label").alias("positive_rate"),
        F.sum(F.when((pred == 1) & (F.col("label") == 1), 1).otherwise(0)).alias("tp"),
        F.sum(F.when((pred == 1) & (F.col("label") == 0), 1).otherwise(0)).alias("fp"),
        F.sum(F.when((pred == 0) & (F.col("label") == 1), 1).otherwise(0)).alias("fn"),
        F.sum(F.when((pred == 0) & (F.col("label") == 0), 1).otherwise(0)).alias("tn"),
        (F.min("label") < F.max("label")).alias("both_classes"))
    aucs = curve_metrics(threshold_table(gp, group_col), group_col=group_col).select(group_col, "roc_auc")
    rep = stats.where((F.col("n") >= min_group_size) & F.col("both_classes")).join(aucs, group_col)
    tpr = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    fpr = F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))
    return rep.select(F.col(group_col).alias("group"), "n", "positive_rate", F.col("roc_auc").alias("auc"),
                      (F.col("roc_auc") - F.lit(overall_auc)).alias("auc_gap"), tpr.alias("tpr"), fpr.alias("fpr"),
                      (fpr - F.lit(overall_fpr)).alias("fpr_gap"),
                      ((F.col("tn") + F.col("fn")) / F.col("n")).alias("approval_rate")).orderBy("auc_gap")
