"""Variable-capacity best-fit packing of documents into training sequences.

Lengths are words plus one separator, so an empty document takes one place. A
document longer than the largest permitted length is cut into pieces that fill
that length; nothing is dropped. The pieces are dealt evenly into shards of a bounded
size. Within a shard, longest first, a piece goes to the open bin whose
room it fills best. When none has room, a bin is opened, its size chosen from all permitted ones
together: of each size it is found what the shard's remaining pieces could still fill, longest first, and the least cost per filled
place wins. So a larger size is opened where a smaller one would stay part empty. In the end each
bin shrinks to the cheapest permitted length that holds its contents, as pieces counted on may have found a tighter bin.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces per shard: bounds a task's memory; each shard leaves at most a few bins part filled.
SHARD_PIECES = 50_000
#: Cost of a sequence of n places: linear work, attention that grows with the square, and a fixed part.
LINEAR, SQUARE, FIXED = 1.0, 1.0 / 8192, 16.0

BIN_SCHEMA = ("bin_id string, capacity int, opened int, used int, doc_ids array<bigint>, piece_starts array<bigint>, "
              "piece_lengths array<int>")


def sequence_cost(capacity: int) -> float:
    return FIXED + LINEAR * capacity + SQUARE * capacity * capacity


def fillable(room: int, counts: list[int], present: int) -> int:
    """Places of ``room`` that pieces fill, longest first; ``counts`` by length, ``present`` a bit per length that is left.

    Equal pieces are taken at once, so a step uses up a length: few steps even for very many short pieces.
    """
    free = room
    while free:
        there = present & ((2 << free) - 1)
        if not there:
            break
        n = there.bit_length() - 1
        free -= n * min(counts[n], free // n)
        present = there & ~(1 << n)
    return room - free


def pack(lengths: list[int], capacities: Iterable[int], cost=sequence_cost) -> list[tuple[int, int, list[int]]]:
    """Best-fit decreasing over several bin sizes -> (final capacity, opened capacity, item positions) per bin.

    ``room`` keeps the open bins by free places; a bit per number of free
    places finds the tightest fit without a search. Ties: earlier item first, last-opened bin first.
    """
    sizes = sorted(set(capacities))
    if not sizes or sizes[0] < 1:
        raise ValueError("capacities must be positive")
    if lengths and (max(lengths) > sizes[-1] or min(lengths) < 1):
        raise ValueError("lengths must lie between 1 and the largest capacity")
    counts, present = [0] * (sizes[-1] + 1), 0
    for n in lengths:
        counts[n] += 1
        present |= 1 << n
    room: dict[int, list[int]] = {}
    free_bits, bins, used, opened = 0, [], [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        counts[n] -= 1
        if not counts[n]:
            present &= ~(1 << n)
        fits = free_bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                free_bits &= ~(1 << free)
        else:
            choices = sizes[bisect_left(sizes, n):]
            free = min(choices, key=lambda c: (cost(c) / (n + fillable(c - n, counts, present)), c))
            b = len(bins)
            bins.append([])
            used.append(0)
            opened.append(free)
        bins[b].append(i)
        used[b] += n
        free -= n
        if free:
            room.setdefault(free, []).append(b)
            free_bits |= 1 << free
    return [(min(sizes[bisect_left(sizes, u):], key=lambda c: (cost(c), c)), o, items) for u, o, items in zip(used, opened, bins)]


def pieces(docs: DataFrame, largest: int) -> DataFrame:
    """(doc_id, text) -> (doc_id, start, length): pieces of at most ``largest`` places."""
    n = (F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")
    starts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n")).select(
        "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(largest).cast("long"))).alias("start"))
    return starts.select("doc_id", "start", F.least(F.lit(largest), F.col("n") - F.col("start")).cast("int").alias("length"))


def best_fit_packing(docs: DataFrame, capacities: Iterable[int] = CAPACITIES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per packed sequence: bin_id, capacity, opened (its capacity before downsizing), used, doc_ids, piece_starts, piece_lengths.

    Every place of every row of ``docs`` is in exactly one sequence. Repeated
    rows are packed like any others, null ids are carried as null, null texts
    count as empty. An empty table gives no rows. Which pieces share a sequence depends on how the
    table's rows are dealt; the guarantees do not.
    """
    sizes = tuple(sorted(set(capacities)))
    cut = scratch(pieces(docs, sizes[-1]), "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))

    def pack_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        ids, starts, lengths = (t.column(c).to_pylist() for c in ("doc_id", "start", "length"))
        found = pack(lengths, sizes)
        for at in range(0, len(found), 5000):
            part = found[at:at + 5000]
            yield pa.RecordBatch.from_arrays([
                pa.array([f"{shard}-{at + i}" for i in range(len(part))]), pa.array([c for c, _, _ in part], pa.int32()), pa.array([o for _, o, _ in part], pa.int32()),
                pa.array([sum(lengths[j] for j in x) for _, _, x in part], pa.int32()),
                pa.array([[ids[j] for j in x] for _, _, x in part], pa.list_(pa.int64())),
                pa.array([[starts[j] for j in x] for _, _, x in part], pa.list_(pa.int64())),
                pa.array([[lengths[j] for j in x] for _, _, x in part], pa.list_(pa.int32()))],
                names=["bin_id", "capacity", "opened", "used", "doc_ids", "piece_starts", "piece_lengths"])

    # dealt in turn, not by a key: no id, length or source can fill a shard
    return cut.repartition(shards).mapInArrow(pack_shard, BIN_SCHEMA)
