"""S3: Structured Streaming scoring (re-aimed from the request/response endpoint).

Requests arrive as Parquet files in a folder, read with ``readStream`` (explicit
schema). Each query keeps its progress in ``checkpoint_dir`` and its results
under ``sink_dir``; both are arguments, belong together and are meant to be
kept: a query started again on them goes on after the last finished
micro-batch. A micro-batch that was cut short is run again and overwrites its
own part of the sink, so every request is in the result exactly once. State kept between micro-batches
(``state_dir``, see ``state``) follows the same rule and belongs to the same checkpoint.
Intermediate tables of a micro-batch are deleted at its end.

``trigger`` is what ``DataStreamWriter.trigger`` takes; by default
``availableNow`` works off what is there and returns. With any other trigger
the running query is returned and the caller stops it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph_state as GS
from ..operators import scoring as S
from ..operators import velocity as W
from ..plans.training import TrainingResult, score_batch
from ..sources.scratch import scratch_scope
from .state import EpochTable

AVAILABLE_NOW = {"availableNow": True}


def stream_requests(spark: SparkSession, source_dir: str, schema, files_per_epoch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_epoch) if files_per_epoch else reader).parquet(source_dir)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint_dir: str, trigger: dict | None,
         mode: str = "append") -> StreamingQuery:
    trigger = trigger or AVAILABLE_NOW

    def scoped(batch: DataFrame, epoch: int) -> None:
        with scratch_scope():
            handle(batch, epoch)

    q = (stream.writeStream.outputMode(mode).foreachBatch(scoped)
         .option("checkpointLocation", checkpoint_dir).trigger(**trigger).start())
    if trigger == AVAILABLE_NOW:
        q.awaitTermination()
    return q


def write_epoch(out: DataFrame, sink_dir: str, epoch: int) -> None:
    """An epoch owns a folder of the sink: running it again replaces what it wrote before."""
    out.write.mode("overwrite").parquet(f"{sink_dir}/epoch={epoch}")


def banding_stream(spark: SparkSession, source_dir: str, schema, sink_dir: str, checkpoint_dir: str,
                   score_col: str = "score", trigger: dict | None = None) -> StreamingQuery:
    """Stateless stream: band every arriving row."""
    banded = stream_requests(spark, source_dir, schema).select(
        "id", S.decision(score_col).alias("decision"), F.round(score_col, 6).alias("fraud_score"))
    return run_batches(banded, lambda batch, epoch: write_epoch(batch, sink_dir, epoch), checkpoint_dir, trigger)


def decision_count_stream(spark: SparkSession, source_dir: str, schema, sink_dir: str, checkpoint_dir: str,
                          score_col: str = "score", trigger: dict | None = None) -> StreamingQuery:
    """S4 as a streaming aggregation: after each micro-batch the sink holds the totals so far."""
    counts = stream_requests(spark, source_dir, schema).groupBy(S.decision(score_col).alias("decision")) \
        .agg(F.count(F.lit(1)).alias("n"))
    return run_batches(counts, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{sink_dir}/totals"),
                checkpoint_dir, trigger, mode="complete")


class RequestHistory:
    """What a stream remembers of the requests it has accepted: velocity counts (W1) and the linkage graph (GR1-GR4)."""

    def __init__(self, spark: SparkSession, state_dir: str, compact_every: int = 16):
        def kept(name: str, schema: str, merge, *sort_by: str) -> EpochTable:
            return EpochTable(spark, f"{state_dir.rstrip('/')}/{name}", schema, merge, compact_every, sort_by)

        self.days = kept("velocity", "k string, kv string, day int, n_day long", W.merge_state, "day", "k", "kv")
        self.hubs = kept("hubs", GS.HUBS_SCHEMA, GS.merge_hubs, "hub")
        self.sizes = kept("sizes", GS.SIZES_SCHEMA, GS.merge_sizes, "component")
        self.moved = kept("moved", GS.MOVED_SCHEMA, GS.merge_moved, "component")

    def velocity(self, epoch: int) -> DataFrame:
        return self.days.rows_before(epoch)

    def graph(self, epoch: int) -> GS.GraphState:
        return GS.GraphState(*[t.rows_before(epoch) for t in (self.hubs, self.sizes, self.moved)])

    def put(self, epoch: int, days: DataFrame | None, update: GS.GraphUpdate | None) -> None:
        if days is not None:
            self.days.put(epoch, days)
        if update is not None:
            for t, rows in ((self.hubs, update.hubs), (self.sizes, update.sizes), (self.moved, update.moved)):
                t.put(epoch, rows)


def velocity_stream(spark: SparkSession, source_dir: str, schema, sink_dir: str, state_dir: str, checkpoint_dir: str,
                    keys=W.DEFAULT_KEYS, windows_days=W.DEFAULT_WINDOWS, trigger: dict | None = None,
                    files_per_epoch: int | None = None, compact_every: int = 16) -> StreamingQuery:
    """W1 over a stream: each row's trailing counts among all rows that arrived before it, of any micro-batch.

    Rows of earlier micro-batches count if their day is in the window; inside a micro-batch (day, id) decides.
    Where files arrive in (day, id) order this equals one batch over all rows.
    """
    history = RequestHistory(spark, state_dir, compact_every)

    def handle(batch: DataFrame, epoch: int) -> None:
        out = W.build_velocity_with_history(batch, history.velocity(epoch), keys=keys, windows_days=windows_days)
        write_epoch(out.select("id", *[f"vel_{k}_{w}d" for k in keys for w in windows_days]), sink_dir, epoch)
        history.put(epoch, W.velocity_state(batch, keys=keys), None)

    return run_batches(stream_requests(spark, source_dir, schema, files_per_epoch), handle, checkpoint_dir, trigger)


def graph_stream(spark: SparkSession, source_dir: str, schema, sink_dir: str, state_dir: str, checkpoint_dir: str,
                 keys=GS.DEFAULT_LINK_KEYS, trigger: dict | None = None, files_per_epoch: int | None = None,
                 compact_every: int = 16) -> StreamingQuery:
    """GR1-GR4 over a stream: each row's graph features in the graph of all rows up to its micro-batch."""
    history = RequestHistory(spark, state_dir, compact_every)

    def handle(batch: DataFrame, epoch: int) -> None:
        update = GS.link_batch(batch, history.graph(epoch), keys)
        write_epoch(update.features, sink_dir, epoch)
        history.put(epoch, None, update)

    return run_batches(stream_requests(spark, source_dir, schema, files_per_epoch), handle, checkpoint_dir, trigger)


def model_scoring_stream(spark: SparkSession, source_dir: str, schema, result: TrainingResult, scored_at: str,
                         sink_dir: str, checkpoint_dir: str, velocity_state: DataFrame | None = None,
                         trigger: dict | None = None, state_dir: str | None = None, quarantine_dir: str | None = None,
                         files_per_epoch: int | None = None) -> StreamingQuery:
    """S3: each micro-batch goes through the batch scoring job S2.

    ``quarantine_dir``: the request contract (V3) applies first; an epoch's rejected requests are under
    ``quarantine_dir/epoch=<n>``, replaced if the epoch is run again. ``state_dir``: the stream keeps the velocity counts and the
    linkage graph of the requests it accepted, and later micro-batches are scored against them. Without it
    ``velocity_state`` may name a fixed snapshot, joined by key and day.
    """
    history = RequestHistory(spark, state_dir) if state_dir else None

    def handle(batch: DataFrame, epoch: int) -> None:
        seen = []
        scored = score_batch(
            result, batch, scored_at, velocity_state=history.velocity(epoch) if history else velocity_state,
            quarantine_dir=f"{quarantine_dir}/epoch={epoch}" if quarantine_dir else None,
            graph_state=history.graph(epoch) if history else None, kept=lambda requests, update: seen.append((requests, update)))
        write_epoch(scored, sink_dir, epoch)
        if history:
            requests, update = seen[0]
            history.put(epoch, W.velocity_state(requests), update)

    return run_batches(stream_requests(spark, source_dir, schema, files_per_epoch), handle, checkpoint_dir, trigger)
