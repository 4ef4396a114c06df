"""Trailing event-time window counts per key ("velocity").

W1 (reference rule, ties broken by id): for each row, the number of rows with
the same key that come earlier in (day, id) order and lie at most ``w`` days
back. That is

    #(same key, day in [d - w, d - 1])  +  #(same key, same day, smaller id)

The first term only needs per-(key, day) counts: a partial aggregation, then a
range-frame window over *days* of one key (a key's partition holds one row per
distinct day, bounded by the calendar, however many rows the key has). The
second term is the rank inside a (key, day) group; it comes from one exact
global ordering (G1 range sort over (key, day, id)) minus the group's first
position, so a hot key or a hot day is spread over many tasks instead of
landing in one window partition.

All keys are processed together: the frame is unpivoted to (key column, key
value, day, id), ranked once, and pivoted back by id. Finer time units use prefix
counts instead of a window per key (``_prefix_counts``).

W2 (peer-inclusive, deterministic without a tie key) is #(same key, day in
[d - w, d]) - 1 and needs the aggregation only.

NULL keys and NULL dates give 0 and are not counted by other rows. Missing
date column: the frame passes through; missing keys are skipped. Output
columns are ``vel_{key}_{w}d`` (W2: ``velp_{key}_{w}d``).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .evaluate import prefix_sums
from .ordering import indexed

# Default keys and windows (days).
DEFAULT_KEYS = ("zip_code", "emp_title", "addr_state")
DEFAULT_WINDOWS = (7, 30, 90)


# time units: a day is 1 in "day" units and 86,400,000,000 in "micros" units
UNIT_SCALE = {"day": 1, "micros": 86_400_000_000}


def time_value(c: str, unit: str = "day"):
    """Event time as a number: days since epoch, or microseconds since epoch.

    Microseconds are assembled from the date and the time-of-day fields, so a
    ``timestamp_ntz`` column needs no session time zone.
    """
    d = F.unix_date(F.to_date(F.col(c)))
    if unit == "day":
        return d
    tod = (F.hour(c).cast("long") * 3600 + F.minute(c).cast("long") * 60) * 1_000_000 + \
        (F.date_part(F.lit("SECOND"), F.col(c)) * 1_000_000).cast("long")
    return d.cast("long") * UNIT_SCALE["micros"] + tod


def long_events(df: DataFrame, date_col: str, keys: Sequence[str], id_col: str, unit: str = "day") -> DataFrame:
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("kv")) for c in keys])).alias("e")
    return (df.select(F.col(id_col).alias("_id"), time_value(date_col, unit).alias("day"), kv)
            .select("_id", "day", "e.k", "e.kv")
            .where(F.col("kv").isNotNull() & F.col("day").isNotNull()))


def _day_counts(long: DataFrame, windows: Sequence[int], include_today: bool, *more: Column) -> DataFrame:
    """Per (key, day): rows that day (and ``more`` aggregates) and rows in each trailing window of days."""
    grp = long.groupBy("k", "kv", "day").agg(F.count(F.lit(1)).alias("n_day"), *more)
    w_by_day = Window.partitionBy("k", "kv").orderBy("day")
    hi = 0 if include_today else -1
    for w in windows:
        grp = grp.withColumn(f"c{w}", F.coalesce(F.sum("n_day").over(w_by_day.rangeBetween(-w, hi)), F.lit(0)))
    return grp


def _prefix_counts(df: DataFrame, date_col: str, keys: Sequence[str], windows: Sequence[int], id_col: str,
                   unit: str, include_now: bool, prefix: str) -> DataFrame:
    """Window counts at fine time units, where a key may hold any number of distinct times.

    Events and, per event and window, a probe at the window's start lie in one
    global order (key, time, probes first, id). Prefix counts of events at an
    event and at its probe differ by the events in between, so no window ever
    gathers a key. With ``include_now`` a second probe after all events of the same time ends the window.
    """
    scale = UNIT_SCALE[unit]
    long = materialise(long_events(df, date_col, keys, id_col, unit), "velocity-events")
    marks = [F.struct(F.lit(w).alias("w"), (F.col("day") - F.lit(w * scale)).alias("t"), F.lit(0).alias("kind")) for w in windows]
    marks.append(F.struct(F.lit(0).alias("w"), F.col("day").alias("t"), F.lit(2 if include_now else 1).alias("kind")))
    if include_now:
        marks.append(F.struct(F.lit(-1).alias("w"), F.col("day").alias("t"), F.lit(1).alias("kind")))
    rows = long.select("_id", "k", "kv", F.explode(F.array(*marks)).alias("m")).select(
        "_id", "k", "kv", "m.w", "m.t", "m.kind", (F.col("m.kind") == 1).cast("long").alias("event"))
    order = ["k", "kv", "t", "kind", "_id"]
    counted = prefix_sums(rows, [], [F.col(c) for c in order], order, ["event"])

    def at(w: int) -> Column:
        return F.max(F.when(F.col("w") == w, F.col("cum_event")))

    # the event itself is inside its own window (and counted by the closing mark): it is taken off
    per = counted.groupBy("_id", "k").agg(*[(at(0) - at(w) - 1).cast("int").alias(f"v{w}") for w in windows])
    return pivot_back(df, per, keys, windows, id_col, prefix)


def pivot_back(df: DataFrame, per_key: DataFrame, keys, windows, id_col: str, prefix: str) -> DataFrame:
    aggs = [F.max(F.when(F.col("k") == key, F.col(f"v{w}"))).alias(f"{prefix}_{key}_{w}d")
            for key in keys for w in windows]
    wide = per_key.groupBy(F.col("_id").alias(id_col)).agg(*aggs)
    out = df.join(wide, id_col, "left")
    return out.fillna(0, subset=[f"{prefix}_{key}_{w}d" for key in keys for w in windows])


def build_velocity_features(df: DataFrame, date_col: str = "issue_d", keys: Sequence[str] = DEFAULT_KEYS,
                            windows_days: Sequence[int] = DEFAULT_WINDOWS, id_col: str = "id",
                            unit: str = "day") -> DataFrame:
    """Trailing counts of earlier rows (ties by ``id_col``), current row excluded."""
    if date_col not in df.columns:
        return df
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return df
    if unit != "day":
        return _prefix_counts(df, date_col, keys, windows_days, id_col, unit, False, "vel")
    long = long_events(df, date_col, keys, id_col, unit)
    ranked = indexed(long, ["k", "kv", "day", "_id"], "gidx")
    grp = _day_counts(ranked, windows_days, False, F.min("gidx").alias("first_gidx"))
    per = (ranked.join(grp, ["k", "kv", "day"])
           .select("_id", "k", *[(F.col(f"c{w}") + F.col("gidx") - F.col("first_gidx")).cast("int").alias(f"v{w}")
                                 for w in windows_days]))
    return pivot_back(df, per, keys, windows_days, id_col, "vel")


def build_velocity_peers(df: DataFrame, date_col: str = "issue_d", keys: Sequence[str] = DEFAULT_KEYS,
                         windows_days: Sequence[int] = DEFAULT_WINDOWS, id_col: str = "id",
                         unit: str = "day") -> DataFrame:
    """Rows of the same key within [d - w, d], all same-day peers counted, self excluded."""
    if date_col not in df.columns:
        return df
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return df
    if unit != "day":
        return _prefix_counts(df, date_col, keys, windows_days, id_col, unit, True, "velp")
    # the narrow unpivoted input feeds both the day counts and the join back: compute it once
    long = materialise(long_events(df, date_col, keys, id_col, unit), "velocity-long")
    grp = _day_counts(long, windows_days, True)
    per = long.join(grp, ["k", "kv", "day"]).select(
        "_id", "k", *[(F.col(f"c{w}") - 1).cast("int").alias(f"v{w}") for w in windows_days])
    return pivot_back(df, per, keys, windows_days, id_col, "velp")


# ---------------------------------------------------------------- history-aware velocity

def velocity_state(history: DataFrame, date_col: str = "issue_d", keys: Sequence[str] = DEFAULT_KEYS,
                   id_col: str = "id", unit: str = "day") -> DataFrame:
    """Stored snapshot for scoring: rows of the history per (key column, key value, day).

    One partial aggregation; write it as a table (or checkpoint it) and reuse it
    for every scoring batch instead of recomputing windows inside micro-batches.
    """
    keys = [k for k in keys if k in history.columns]
    return (long_events(history, date_col, keys, id_col, unit)
            .groupBy("k", "kv", "day").agg(F.count(F.lit(1)).alias("n_day")))


def merge_state(rows: DataFrame) -> DataFrame:
    """Counts of several snapshots added up."""
    return rows.groupBy("k", "kv", "day").agg(F.sum("n_day").alias("n_day"))


def build_velocity_with_history(batch: DataFrame, state: DataFrame, date_col: str = "issue_d",
                                keys: Sequence[str] = DEFAULT_KEYS, windows_days: Sequence[int] = DEFAULT_WINDOWS,
                                id_col: str = "id", unit: str = "day") -> DataFrame:
    """Velocity of new rows against a stored history snapshot plus the batch itself.

    count = #history rows with the key and day in [d - w, d]  (history arrived
            before the batch, so same-day history rows all count)
          + #earlier batch rows (day, id order) with the key and day >= d - w.

    The history part touches only the batch's distinct (key, day) pairs: each is
    expanded over the w + 1 days of the widest window and equi-joined with the
    snapshot, so no range join and no per-row expansion is needed. Days outside the batch's reach are
    filtered first, which skips files of a snapshot sorted by day. The state's rows may be unmerged
    (several counts of a day add up).
    """
    if unit != "day":
        raise ValueError("this snapshot is day-granular; velocity_index looks up finer units")
    keys = [k for k in keys if k in batch.columns]
    in_batch = build_velocity_features(batch, date_col, keys, windows_days, id_col, unit)
    long = long_events(batch, date_col, keys, id_col, unit)
    wmax = max(windows_days)
    kd = long.select("k", "kv", "day").distinct()
    reach = long.agg(F.min("day"), F.max("day")).first()
    if reach[0] is not None:
        state = state.where(F.col("day").between(reach[0] - wmax, reach[1]))
    probe = kd.withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(wmax)))) \
        .withColumn("hday", F.col("day") - F.col("off"))
    hit = probe.join(state.withColumnRenamed("day", "hday"), ["k", "kv", "hday"])
    hist = hit.groupBy("k", "kv", "day").agg(
        *[F.sum(F.when(F.col("off") <= w, F.col("n_day")).otherwise(0)).alias(f"h{w}") for w in windows_days])
    per = (long.join(hist, ["k", "kv", "day"], "left")
           .select("_id", "k", *[F.coalesce(F.col(f"h{w}"), F.lit(0)).cast("int").alias(f"v{w}")
                                 for w in windows_days]))
    hist_cols = pivot_back(batch.select(id_col), per, keys, windows_days, id_col, "hvel")
    out = in_batch.join(hist_cols, id_col, "left")
    for key in keys:
        for w in windows_days:
            c = f"vel_{key}_{w}d"
            out = out.withColumn(c, (F.col(c) + F.coalesce(F.col(f"hvel_{key}_{w}d"), F.lit(0))).cast("int")) \
                .drop(f"hvel_{key}_{w}d")
    return out
