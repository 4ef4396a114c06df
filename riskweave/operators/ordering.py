"""G1: exact global order statistics without a one-partition window, and exact quantiles.

Positions in a total order are what the time split (P1), stratified splits,
top-k shares and within-group ranks need. A ``Window`` without
``partitionBy`` would pull every row into one task, so instead:

1. project the *narrow* columns that define the order (never whole rows),
2. ``repartitionByRange`` + ``sortWithinPartitions`` (one shuffle, balanced by
   Spark's range sampler),
3. tag each row with its partition id and its position inside the partition
   (``monotonically_increasing_id`` keeps the position in its low 33 bits),
4. checkpoint that narrow result to the session's reliable checkpoint dir, so
   the per-partition counts and the later selection read the very same
   partitioning (range boundaries come from sampling and are not stable
   between two separate jobs); this also cuts the lineage, so a lost
   executor re-reads files instead of re-sorting,
5. per-partition counts (one row per partition and group, a bounded table)
   give offsets: global position = offset + local position. Wanted rows are
   fetched by (partition, local position) filters; ``indexed`` joins the
   offsets back by broadcast when every row needs its position.

Only rows at requested positions are returned to the driver (a handful of
values), never the data.

Quantiles (L2, B5, F6, F7, D1, M6, S8) need only values at given ranks, not
positions of every row: ``quantiles`` finds them by bucket refinement
(partial aggregations, no sort of the values), with the sort as a fallback.
"""

from __future__ import annotations

import math
from typing import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffle_partitions
from ..sources.scratch import discard, materialise

_POS_MASK = (1 << 33) - 1
# From this many columns on the quantile passes count in numpy, column by column: unpivoted, a pass makes a row of every
# value, and the condition on all columns' intervals takes the driver longer to compile than the tasks to run.
MANY_COLUMNS = 8


def _ranked(df: DataFrame, order_by: Sequence[str | Column], partitions: int | None,
            group_col: str | None = None):
    """Range-sorted, checkpointed narrow frame with _pid/_pos, and its counts.

    Returns ``(ranked, counts)`` where counts maps (pid, group) -> rows; the
    counts table has one row per partition and group (bounded), one job.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n_parts = partitions or shuffle_partitions(spark)
    # the range sampler and the shuffle both read the input: compute it once
    src = materialise(df, "rank-input")
    ranged = (src.repartitionByRange(n_parts, *order_by)
              .sortWithinPartitions(*order_by)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_MASK)))
              .checkpoint(eager=True))
    discard(src)
    keys = ["_pid"] + ([group_col] if group_col else [])
    counts = {(r["_pid"], r[group_col] if group_col else None): r["_cnt"]
              for r in ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt")).collect()}
    return ranged, counts


def _offsets(counts: dict) -> list:
    """Per-partition start offsets in the global order, from (pid, group) counts."""
    per_pid: dict = {}
    for (pid, _), c in counts.items():
        per_pid[pid] = per_pid.get(pid, 0) + c
    out, acc = [], 0
    for pid in sorted(per_pid):
        out.append((pid, acc, per_pid[pid]))
        acc += per_pid[pid]
    return out


def _select(ranked: DataFrame, offsets: list, positions: Iterable[int]) -> dict:
    """Rows at the given global positions, fetched by (partition, local position) filters."""
    by_pid: dict = {}
    for g in sorted(set(int(p) for p in positions)):
        for pid, start, n in offsets:
            if start <= g < start + n:
                by_pid.setdefault(pid, []).append(g - start)
                break
    if not by_pid:
        return {}
    cond = None
    for pid, locs in by_pid.items():
        c = (F.col("_pid") == pid) & F.col("_pos").isin(locs)
        cond = c if cond is None else (cond | c)
    start_of = {pid: start for pid, start, _ in offsets}
    return {start_of[r["_pid"]] + r["_pos"]: r for r in ranked.where(cond).collect()}


def indexed(df: DataFrame, order_by: Sequence[str | Column], index_col: str = "gidx",
            partitions: int | None = None) -> DataFrame:
    """Return ``df`` (keep it narrow) with an exact 0-based ``index_col`` in ``order_by`` order.

    Ties are ordered arbitrarily; include a unique key in ``order_by`` when the
    position of tied rows matters.
    """
    ranged, counts = _ranked(df, order_by, partitions)
    offsets = [(pid, start) for pid, start, _ in _offsets(counts)]
    off_df = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_pid int, _off long")
    # one row per partition: a bounded table
    return (ranged.join(F.broadcast(off_df), "_pid")
            .withColumn(index_col, F.col("_off") + F.col("_pos"))
            .drop("_pid", "_pos", "_off"))


def rows_at(df: DataFrame, order_by: Sequence[str | Column], positions: Iterable[int],
            partitions: int | None = None) -> list:
    """Rows at the given 0-based positions of the total order (collected; the list is small).

    Each row carries ``_gidx``; positions beyond the end are skipped.
    """
    ranked, counts = _ranked(df, order_by, partitions)
    got = _select(ranked, _offsets(counts), positions)
    out = []
    for g in sorted(got):
        d = got[g].asDict()
        d["_gidx"] = g
        out.append(d)
    return out


def ranked_positions(df: DataFrame, order_by: Sequence[str | Column], partitions: int | None = None):
    """(total rows, fetch(positions) -> {position: row dict}) over one checkpointed sort.

    Lets a caller learn the row count and then fetch cut rows without a second pass.
    """
    ranked, counts = _ranked(df, order_by, partitions)
    offsets = _offsets(counts)
    total = sum(n for _, _, n in offsets)

    def fetch(positions):
        return {g: r.asDict() for g, r in _select(ranked, offsets, positions).items()}
    return total, fetch


def _unpivot(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature index, value) pairs of the non-null, non-NaN numeric values."""
    stacked = F.explode(F.array(*[
        F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)
    ])).alias("kv")
    return (df.select(stacked).select("kv.f", "kv.v")
            .where(F.col("v").isNotNull() & ~F.isnan("v")))


def interpolate(lo: float, hi: float, frac: float) -> float:
    return lo if frac == 0 or lo == hi else lo + (hi - lo) * frac


def _extents(long: DataFrame) -> dict:
    """Per feature: least and largest finite value, their number, how many are -inf, and the number of all values."""
    infinite = F.abs(F.col("v")) == F.lit(float("inf"))
    finite = F.when(~infinite, F.col("v"))
    return {r["f"]: r for r in long.groupBy("f").agg(
        F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count(finite).alias("n"),
        F.sum((infinite & (F.col("v") < 0)).cast("long")).alias("minus"), F.count(F.lit(1)).alias("all")).collect()}


def _within(narrow: DataFrame, cols: Sequence[str], intervals: Iterable[tuple]) -> DataFrame:
    """(f, v) of the values inside one of the intervals (f, lo, hi); the others go before the columns are unpivoted."""
    kept: dict = {}
    for f, lo, hi in intervals:
        inside = F.col(cols[f]).between(F.lit(float(lo)), F.lit(float(hi)))
        kept[f] = kept[f] | inside if f in kept else inside
    return _unpivot(narrow.select(*[F.when(kept[f], F.col(c)).alias(c) if f in kept else F.lit(None).cast("double").alias(c)
                                    for f, c in enumerate(cols)]), cols)


def _extents_of_columns(narrow: DataFrame, cols: Sequence[str]) -> dict:
    """``_extents`` of the columns' values; each task gives one row per column."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict = {}
        for batch in batches:
            for f in range(batch.shape[1]):
                v = batch.iloc[:, f].to_numpy(dtype=float)
                v = v[~np.isnan(v)]                  # NULL comes as NaN
                finite = v[np.isfinite(v)]
                if len(v):
                    lo, hi, n, minus, every = found.get(f, (np.inf, -np.inf, 0, 0, 0))
                    if len(finite):
                        lo, hi = min(lo, finite.min()), max(hi, finite.max())
                    found[f] = (lo, hi, n + len(finite), minus + int((v == -np.inf).sum()), every + len(v))
        yield pd.DataFrame([(f, *e) for f, e in found.items()], columns=["f", "lo", "hi", "n", "minus", "every"])

    parts = narrow.select(*cols).mapInPandas(work, "f int, lo double, hi double, n long, minus long, every long")
    return {r["f"]: r for r in parts.groupBy("f").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.sum("minus").alias("minus"),
        F.sum("every").alias("all")).collect()}


def _counts_of_columns(narrow: DataFrame, cols: Sequence[str], intervals: Sequence[tuple], buckets: int) -> DataFrame:
    """(j, b, c, mn, mx): number, least and largest of the values in bucket b of interval j = (f, lo, hi), a row per task
    that has any. The open intervals of a column do not overlap; a task holds one count per interval and bucket."""
    by_column = {f: sorted((float(lo), float(hi), j) for j, (g, lo, hi) in enumerate(intervals) if g == f) for f, _, _ in intervals}
    asked = sorted(by_column)
    total = len(intervals) * buckets

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, least, largest = np.zeros(total, dtype=np.int64), np.full(total, np.inf), np.full(total, -np.inf)
        for batch in batches:
            for at, f in enumerate(asked):
                lo, hi, j = (np.array(x) for x in zip(*by_column[f]))
                v = batch.iloc[:, at].to_numpy(dtype=float)
                i = np.searchsorted(lo, v, side="right") - 1
                inside = (i >= 0) & (v <= hi[i])     # never NULL or NaN
                v, i = v[inside], i[inside]
                width = hi[i] / 2 - lo[i] / 2
                share = np.divide(v / 2 - lo[i] / 2, width, out=np.zeros(len(v)), where=width > 0)
                at_bucket = j[i] * buckets + np.minimum((share * buckets).astype(np.int64), buckets - 1)
                np.add.at(count, at_bucket, 1)
                np.minimum.at(least, at_bucket, v)
                np.maximum.at(largest, at_bucket, v)
        hit = np.flatnonzero(count)
        yield pd.DataFrame({"j": hit // buckets, "b": hit % buckets, "c": count[hit], "mn": least[hit], "mx": largest[hit]})

    return narrow.select(*[cols[f] for f in asked]).mapInPandas(work, "j int, b int, c long, mn double, mx double")


def _order_stats_refine(long: DataFrame, wanted: dict, buckets: int = 1024, max_passes: int = 40, ext: dict | None = None,
                        within: Callable[[Iterable[tuple]], DataFrame] | None = None,
                        counted: Callable[[Sequence[tuple], int], DataFrame] | None = None) -> dict:
    """Exact order statistics of ``long`` (f, v) by bucket refinement, without sorting the data.

    ``wanted`` maps feature -> set of 0-based ranks; ``ext`` has the ``_extents`` of ``long`` if known, ``within`` gives
    its rows inside given intervals, at less cost than a filter, ``counted`` what the tasks counted in them. Infinite values are counted first and settle the ranks they cover. Per remaining target the state is an
    interval [lo, hi] of actual values plus the number of values below lo. Each
    pass is ONE partial aggregation of (interval, bucket) -> count/min/max
    against a broadcast table of the open intervals (at most one per target);
    the target's bucket becomes its next interval (its true min/max,
    so no floating-point edge can lose a value), until its ends are equal. Only
    bucket counts reach the driver, never values in bulk.
    Returns {(feature, rank): value}; targets still open after ``max_passes``
    are returned as missing (the caller falls back to the sort).
    """
    spark = long.sparkSession
    ext = _extents(long) if ext is None else ext
    done: dict = {}
    state: dict = {}
    for f, ks in wanted.items():
        if f not in ext:
            continue
        e = ext[f]
        for k in ks:
            if k < e["minus"]:
                done[(f, k)] = float("-inf")
            elif k >= e["minus"] + e["n"]:
                done[(f, k)] = float("inf")
            else:
                state[(f, k)] = (e["lo"], e["hi"], e["minus"])
    for _ in range(max_passes):
        for t, (lo, hi, _below) in list(state.items()):
            if lo == hi:
                done[t] = lo
                del state[t]
        if not state:
            break
        ivs = sorted({(t[0], st[0], st[1]) for t, st in state.items()})
        iv_id = {iv: j for j, iv in enumerate(ivs)}
        if counted:
            rows = counted(ivs, buckets).groupBy("j", "b").agg(F.sum("c").alias("c"), F.min("mn").alias("mn"), F.max("mx").alias("mx")).collect()
        else:
            iv_df = spark.createDataFrame([(f, j, float(lo), float(hi)) for (f, lo, hi), j in iv_id.items()],
                                          "f int, j int, lo double, hi double")
            # halved before the difference, so that the width of the full double range is finite
            share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
            b = F.least(F.floor(share * F.lit(float(buckets))).cast("int"), F.lit(buckets - 1))
            rows = ((within(ivs) if within else long).join(F.broadcast(iv_df), "f")          # one row per open interval of the feature
                    .where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
                    .groupBy("j", b.alias("b"))
                    .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("mn"), F.max("v").alias("mx"))
                    .collect())
        per_iv: dict = {}
        for r in rows:
            per_iv.setdefault(r["j"], []).append((r["b"], r["c"], r["mn"], r["mx"]))
        for t, (lo, hi, below) in state.items():
            acc = below
            for _b, c, mn, mx in sorted(per_iv.get(iv_id[(t[0], lo, hi)], [])):
                if acc + c > t[1]:
                    state[t] = (mn, mx, acc)
                    break
                acc += c
    return done


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], method: str = "exact",
              decimals: int | None = 6, accuracy: int = 100_000,
              points: bool = False, stored: bool = False) -> dict[str, list]:
    """Quantiles of several columns at once, NULL/NaN ignored.

    ``exact``: linear interpolation between order statistics (the definition of
    pandas/numpy ``quantile`` and SQL ``percentile_cont``). The order statistics
    come from bucket refinement (``_order_stats_refine``): a few partial
    aggregations over the unpivoted (feature, value) pairs, no sort and no
    shuffle of the values. No group is ever held by one task, unlike the
    ``percentile`` aggregate whose value->count map for a column ends up in a
    single task.
    ``sort``: the same order statistics from one range sort (G1).
    ``approx``: ``percentile_approx`` with the given accuracy (one pass, no sort).
    ``points=True`` (exact only) returns the raw ``(lower, upper, fraction)``
    order statistics instead, so a caller can apply a monotone map (a clip)
    before interpolating. ``stored``: ``df`` selects columns of a written table, which the passes
    read as it is.

    Edges are rounded to ``decimals`` so values compare alike across engines
    (floating-point interpolation differs in the last bits).
    """
    cols = list(cols)
    probs = [float(p) for p in probs]

    def rnd(x):
        return None if x is None else (round(x, decimals) if decimals is not None else x)

    if not cols:
        return {}
    narrow = df
    if method == "exact":       # the columns are written once, each pass reads them and unpivots them on the fly
        narrow = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
        narrow = narrow if stored else materialise(narrow, "quantile-input")
    long = _unpivot(narrow, cols)
    if method == "approx":
        rows = (long.groupBy("f").agg(F.percentile_approx("v", probs, accuracy).alias("q")).collect())
        got = {r["f"]: [rnd(x) for x in r["q"]] for r in rows}
        return {c: got.get(i, [None] * len(probs)) for i, c in enumerate(cols)}
    if method not in ("exact", "sort"):
        raise ValueError(f"unknown quantile method {method!r}")

    if method == "exact":
        src, many = long, len(cols) >= MANY_COLUMNS
        ext = _extents_of_columns(narrow, cols) if many else _extents(src)
        counts = {f: r["all"] for f, r in ext.items()}
    else:
        ranked, pcounts = _ranked(long, ["f", "v"], None, group_col="f")
        counts = {}
        for (_, f), c in pcounts.items():
            counts[f] = counts.get(f, 0) + c
    start, acc = {}, 0
    for i in range(len(cols)):
        start[i] = acc
        acc += counts.get(i, 0)
    plan, wanted = {}, set()
    for i in range(len(cols)):
        n = counts.get(i, 0)
        for j, p in enumerate(probs):
            if n == 0:
                continue
            h = (n - 1) * p
            lo, hi = math.floor(h), math.ceil(h)
            plan[(i, j)] = (start[i] + lo, start[i] + hi, h - lo)
            wanted.update((start[i] + lo, start[i] + hi))
    if not wanted:
        if method == "exact" and not stored:
            discard(narrow)
        return {c: [None] * len(probs) for c in cols}
    if method == "exact":
        # global positions -> (feature, rank within feature)
        by_f: dict = {}
        for g in wanted:
            f = max(i for i in range(len(cols)) if start[i] <= g and counts.get(i, 0) > 0 and g < start[i] + counts[i])
            by_f.setdefault(f, set()).add(g - start[f])
        found = _order_stats_refine(src, by_f, ext=ext, within=lambda ivs: _within(narrow, cols, ivs),
                                    counted=(lambda ivs, buckets: _counts_of_columns(narrow, cols, ivs, buckets)) if many else None)
        missing = {(f, k) for f, ks in by_f.items() for k in ks if (f, k) not in found}
        if missing:     # pathological clustering: finish those ranks with the sort
            ranked, pcounts = _ranked(src, ["f", "v"], None, group_col="f")
            extra = _select(ranked, _offsets(pcounts), [start[f] + k for f, k in missing])
            for g, r in extra.items():
                found[(r["f"], g - start[r["f"]])] = r["v"]
        if not stored:
            discard(narrow)
        vals = {start[f] + k: v for (f, k), v in found.items()}
    else:
        vals = {g: r["v"] for g, r in _select(ranked, _offsets(pcounts), wanted).items()}
    out = {}
    for i, c in enumerate(cols):
        res = []
        for j in range(len(probs)):
            if (i, j) not in plan:
                res.append(None)
                continue
            a, b, frac = plan[(i, j)]
            res.append((vals[a], vals[b], frac) if points else rnd(interpolate(vals[a], vals[b], frac)))
        out[c] = res
    return out


def quantile(df: DataFrame, col: str, p: float, **kw) -> float | None:
    return quantiles(df, [col], [p], **kw)[col][0]
