"""Streams that watch the requests themselves: V2 (unique ids), S4/S5 and D3 per time window.

``unique_requests_stream`` lets each request id through once. A watermark follows the event time: the largest time of
earlier micro-batches minus the allowed delay. Requests behind it are late, ids that came
before (since the watermark) are repeated, and both are listed with a reason instead of being dropped
silently. Only ids since the watermark are kept, so the state is bounded by the traffic of the delay.

``decision_windows_stream`` and ``drift_windows_stream`` count per tumbling window of event time, with a watermark: a window
is written once, when it can no longer change. Counts merge by addition; ``psi_by_window`` turns bin counts into
PSI against a stored reference.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import drift as D
from ..operators import scoring as S
from ..sources.scratch import materialise
from .scoring import AVAILABLE_NOW, run_batches, stream_requests, write_epoch
from .state import EpochTable


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.max("at").alias("at"))


def unique_requests_stream(spark: SparkSession, source_dir: str, schema, sink_dir: str, rejects_dir: str, state_dir: str,
                           checkpoint_dir: str, time_col: str, delay: str = "30 days", trigger: dict | None = None,
                           files_per_epoch: int | None = None, compact_every: int = 16) -> StreamingQuery:
    """V2: every id once (the earliest row of its micro-batch; of equal times the smallest as JSON).

    Rejected rows are written as (id, reason, request): ``no id``, ``no time``, ``late``, ``repeated``. An id may come again
    after the delay has passed since its last accepted request.
    """
    ids = EpochTable(spark, f"{state_dir}/ids", "id string, at timestamp_ntz", _latest, compact_every)
    clock = EpochTable(spark, f"{state_dir}/clock", "at timestamp_ntz", lambda r: r.agg(F.max("at").alias("at")), compact_every)

    def handle(batch: DataFrame, epoch: int) -> None:
        last = clock.before(epoch).first()[0]
        mark = F.lit(last).cast("timestamp_ntz") - F.expr(f"INTERVAL {delay}") if last is not None else F.lit(None).cast("timestamp_ntz")
        at, key = F.col(time_col).cast("timestamp_ntz"), F.col("id").cast("string")
        rows = materialise(batch.select(key.alias("_key"), at.alias("_at"), F.to_json(F.struct(*batch.columns)).alias("_request"), *batch.columns), "requests")
        reason = F.when(F.col("_key").isNull(), "no id").when(F.col("_at").isNull(), "no time") \
            .when(F.coalesce(F.col("_at") < mark, F.lit(False)), "late")
        rows = rows.withColumn("_reason", reason)
        # a batch's rows of one id: the first stays; counted by aggregation, so a crowded id is one row per task
        fine = rows.where("_reason IS NULL")
        first = fine.groupBy("_key").agg(F.min(F.struct("_at", "_request")).alias("_first"))
        seen = ids.rows_before(epoch).where(F.coalesce(F.col("at") >= mark, F.lit(True))).select(F.col("id").alias("_key")).distinct()
        first = materialise(first.join(seen, "_key", "left_anti"), "first-requests")
        stays = materialise(fine.join(first, "_key", "left").withColumn(
            "_stays", F.coalesce(F.struct("_at", "_request") == F.col("_first"), F.lit(False))), "judged-requests")
        # equal rows of one id differ in nothing: one of them stays
        accepted = stays.where("_stays").dropDuplicates(["_key"])
        extra = stays.where("_stays").groupBy("_key", "_request").agg((F.count(F.lit(1)) - 1).cast("int").alias("n")).where("n > 0") \
            .select("_key", F.lit("repeated").alias("_reason"), F.explode(F.array_repeat("_request", F.col("n"))).alias("_request"))
        rejected = rows.where("_reason IS NOT NULL").select("_key", "_reason", "_request") \
            .unionByName(stays.where("NOT _stays").select("_key", F.lit("repeated").alias("_reason"), "_request")).unionByName(extra)
        write_epoch(accepted.select(*batch.columns), sink_dir, epoch)
        write_epoch(rejected.select(F.col("_key").alias("id"), F.col("_reason").alias("reason"), F.col("_request").alias("request")), rejects_dir, epoch)
        ids.put(epoch, accepted.select(F.col("_key").alias("id"), F.col("_at").alias("at")))
        clock.put(epoch, rows.agg(F.max("_at").alias("at")).where("at IS NOT NULL"))

    return run_batches(stream_requests(spark, source_dir, schema, files_per_epoch), handle, checkpoint_dir, trigger)


def decision_windows(scored: DataFrame, time_col: str, width: str, by: Sequence[str] = ("endpoint",), score: str = "score") -> DataFrame:
    """S4 and S5 per window: (window_start, ``by``, decision, score_bin, n); a bin is a twentieth of the score range, 0 is at most 0."""
    bin_ = F.least(F.greatest(F.ceil(F.round(F.col(score), 6) * 20), F.lit(0)), F.lit(20)).cast("int")
    return scored.groupBy(F.window(time_col, width).alias("w"), *by, S.decision(score).alias("decision"), bin_.alias("score_bin")) \
        .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *by, "decision", "score_bin", "n")


def drift_windows(frame: DataFrame, reference: D.DriftReference, time_col: str, width: str) -> DataFrame:
    """D3's counts per window: (window_start, feature, bin, n) for the reference's features; missing values say nothing."""
    edges = {r["feature"]: r["edges"] for r in reference.edges.collect()}      # one row per feature
    cols = [c for c in edges if c in frame.columns]

    def bin_of(c: str) -> Column:
        x = F.col(c).cast("double")
        below = sum(((x >= F.lit(e)).cast("int") for e in edges[c]), F.lit(0))
        return F.when(x.isNotNull() & ~F.isnan(x), F.struct(F.lit(c).alias("feature"), below.alias("bin")))

    long = frame.select(F.col(time_col), F.explode(F.array(*[bin_of(c) for c in cols])).alias("b")).where("b IS NOT NULL")
    return long.groupBy(F.window(time_col, width).alias("w"), "b.feature", "b.bin") \
        .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "feature", "bin", "n")


def psi_by_window(counts: DataFrame, reference: D.DriftReference, alert: float = D.ALERT, min_current: int = D.MIN_CURRENT) -> DataFrame:
    """(window_start, feature, psi, alert) from bin counts, which may come in several rows per bin."""
    total = counts.groupBy("window_start", "feature").agg(F.sum("n").alias("total")).where(F.col("total") >= min_current)
    bins = counts.groupBy("window_start", "feature", "bin").agg(F.sum("n").alias("n"))
    grid = total.join(reference.expected, "feature").join(bins, ["window_start", "feature", "bin"], "left")
    share = F.greatest(F.coalesce(F.col("n"), F.lit(0)) / F.col("total"), F.lit(D.FLOOR))
    psi = F.sum((share - F.col("expected_pct")) * F.log(share / F.col("expected_pct")))
    return grid.groupBy("window_start", "feature").agg(psi.alias("psi")).withColumn("alert", F.col("psi") > F.lit(alert))


def _closed_windows(counts: DataFrame, sink_dir: str, checkpoint_dir: str, trigger: dict | None) -> StreamingQuery:
    trigger = trigger or AVAILABLE_NOW
    q = counts.writeStream.outputMode("append").format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_dir) \
        .trigger(**trigger).start()
    if trigger == AVAILABLE_NOW:
        q.awaitTermination()
    return q


def decision_windows_stream(spark: SparkSession, source_dir: str, schema, sink_dir: str, checkpoint_dir: str, time_col: str, width: str,
                            delay: str, by: Sequence[str] = ("endpoint",), score: str = "score", trigger: dict | None = None) -> StreamingQuery:
    """Finished windows of ``decision_windows``; rows later than ``delay`` are not counted."""
    rows = stream_requests(spark, source_dir, schema).withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay)
    return _closed_windows(decision_windows(rows, time_col, width, by, score), sink_dir, checkpoint_dir, trigger)


def drift_windows_stream(spark: SparkSession, source_dir: str, schema, reference: D.DriftReference, sink_dir: str, checkpoint_dir: str,
                         time_col: str, width: str, delay: str, trigger: dict | None = None) -> StreamingQuery:
    """Finished windows of ``drift_windows``; ``psi_by_window`` reads the sink."""
    rows = stream_requests(spark, source_dir, schema).withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay)
    return _closed_windows(drift_windows(rows, reference, time_col, width), sink_dir, checkpoint_dir, trigger)
