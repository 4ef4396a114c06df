"""Exact duplicates through a minimal perfect hash over historical digests.

The digests of the history are grouped (count and winner per distinct digest),
dealt by hash into buckets of a bounded size, and each bucket builds a minimal
perfect hash: levels of bit maps, every level placing the digests that fall on
a position alone, the rest moving on. A set bit's rank is the slot; slots hold
the full digest, the winner's id and the row count. Looking up a digest walks
the levels, reads one slot and compares all 32 bytes, so a digest that is not a
member is told apart for certain; non-members form groups of their own.

The index is a table (one row per bucket) and may be kept: ``build_index`` and
``lookup`` work on any history and any later batch.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, lower_ascii, scratch, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Expected distinct digests of a bucket: bounds what one task holds (about 1 MB).
BUCKET_DIGESTS = 20_000
#: Positions per digest left, of each level.
SPREAD = 2.0
#: Stands for "no id" in the winner locators of the slots.
NO_ID = -(1 << 63)

INDEX_SCHEMA = "bucket long, n long, level_sizes array<long>, bits binary, digests binary, winners binary, counts binary"
TOTALS_SCHEMA = "digest binary, keep_id long, group_size long, member boolean"


def digests(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) -> (doc_id, digest) and the columns ``carry``: SHA-256 of the text with A-Z lower-cased; null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry,
                       F.unhex(F.sha2(lower_ascii(text_or_empty()), 256)).alias("digest"))


def _halves(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = d.view("<u8").reshape(len(d), 4)
    return v[:, 0] ^ v[:, 2], v[:, 1] ^ v[:, 3]


def _position(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h1 + np.uint64(2 * level + 1) * h2
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


def build_mph(d: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Distinct digests [n, 32] -> level sizes, all level bits (0/1), slot of each digest."""
    h1, h2 = _halves(d)
    left, sizes, maps = np.arange(len(d)), [], []
    slot, base = np.empty(len(d), np.int64), 0
    while len(left):
        if len(sizes) > 200:
            raise ValueError("digests of a bucket are not distinct")
        size = max(8, int(SPREAD * len(left)))
        pos = _position(h1[left], h2[left], len(sizes), size)
        alone = np.bincount(pos, minlength=size) == 1
        placed = alone[pos]
        rank = np.cumsum(alone) - 1
        slot[left[placed]] = base + rank[pos[placed]]
        base += int(placed.sum())
        sizes.append(size)
        maps.append(alone)
        left = left[~placed]
    return sizes, np.concatenate(maps) if maps else np.zeros(0, bool), slot


def find_slots(d: np.ndarray, sizes, bits: np.ndarray) -> np.ndarray:
    """Slot each digest would have (-1: no level takes it). Members get theirs; others may get any."""
    h1, h2 = _halves(d)
    rank = np.cumsum(bits) - 1
    out, left, start = np.full(len(d), -1, np.int64), np.arange(len(d)), 0
    for level, size in enumerate(sizes):
        pos = start + _position(h1[left], h2[left], level, int(size))
        hit = bits[pos]
        out[left[hit]] = rank[pos[hit]]
        left, start = left[~hit], start + int(size)
    return out


def _matrix(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in col), np.uint8).reshape(len(col), 32)


def _ids(col: pd.Series) -> np.ndarray:
    return np.array([NO_ID if x is None or x != x else int(x) for x in col.tolist()], np.int64)


def _index_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    d = _matrix(pdf["digest"])
    sizes, bits, slot = build_mph(d)
    order = np.empty(len(d), np.int64)
    order[slot] = np.arange(len(d))
    return pd.DataFrame([{
        "bucket": pdf["bucket"].iloc[0], "n": len(d), "level_sizes": sizes, "bits": np.packbits(bits).tobytes(),
        "digests": d[order].tobytes(), "winners": _ids(pdf["winner"])[order].tobytes(),
        "counts": pdf["n"].to_numpy(np.int64)[order].tobytes()}])


def bucketed(grouped: DataFrame, buckets: int) -> DataFrame:
    return grouped.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))


def group_digests(rows: DataFrame) -> DataFrame:
    """One row per distinct digest: the largest id (null ids lose) and the row count."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """Digest rows of the history -> the perfect-hash index, one row per non-empty bucket."""
    return bucketed(group_digests(history), buckets).groupBy("bucket").applyInPandas(_index_bucket, INDEX_SCHEMA)


def _merge_bucket(index: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    """Totals of one bucket: every slot with what the batch adds to it, then the non-members."""
    new_d = _matrix(batch["digest"]) if len(batch) else np.zeros((0, 32), np.uint8)
    new_ids, new_n = _ids(batch["winner"]), batch["n"].to_numpy(np.int64)
    slot = np.full(len(new_d), -1, np.int64)
    old_d, old_ids, old_n = np.zeros((0, 32), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(index):
        row = index.iloc[0]
        old_d = np.frombuffer(bytes(row["digests"]), np.uint8).reshape(-1, 32)
        old_ids = np.frombuffer(bytes(row["winners"]), np.int64).copy()
        old_n = np.frombuffer(bytes(row["counts"]), np.int64).copy()
        sizes = [int(x) for x in row["level_sizes"]]
        bits = np.unpackbits(np.frombuffer(bytes(row["bits"]), np.uint8))[:sum(sizes)].astype(bool)
        if len(new_d):
            slot = find_slots(new_d, sizes, bits)
            found = np.flatnonzero(slot >= 0)
            same = (old_d[slot[found]] == new_d[found]).all(axis=1)  # all 32 bytes decide
            slot[found[~same]] = -1
    hit = slot >= 0
    np.maximum.at(old_ids, slot[hit], new_ids[hit])
    np.add.at(old_n, slot[hit], new_n[hit])
    d = np.concatenate([old_d, new_d[~hit]])
    ids = np.concatenate([old_ids, new_ids[~hit]])
    return pd.DataFrame({
        "digest": [x.tobytes() for x in d], "keep_id": pd.array(ids, "Int64").copy() if not (ids == NO_ID).any()
        else pd.array([None if x == NO_ID else x for x in ids.tolist()], "Int64"),
        "group_size": np.concatenate([old_n, new_n[~hit]]),
        "member": np.concatenate([np.ones(len(old_d), bool), np.zeros(int((~hit).sum()), bool)])})


def lookup(index: DataFrame, batch: DataFrame, buckets: int) -> DataFrame:
    """Index and digest rows of a batch -> one row per distinct digest of either.

    The batch is grouped by digest before it moves, so a text that fills the
    batch costs one row per task.
    """
    grouped = bucketed(group_digests(batch), buckets)
    return index.groupBy("bucket").cogroup(grouped.groupBy("bucket")).applyInPandas(_merge_bucket, TOTALS_SCHEMA)


def exact_duplicates(docs: DataFrame, buckets: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, the columns ``carry``, keep_id, group_size, kept, text_sha256.

    The older half of the id range (null ids too) is the history that is indexed, the newer half
    the batch that is looked up. Of equal texts the largest doc_id stays; equal
    rows with one id are all marked kept. Null
    text counts as empty. A group without any id has a null keep_id, and its rows are kept.
    """
    rows = scratch(digests(docs, carry), "digests")
    total, low, high = rows.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    buckets = buckets or max(1, -(-total // BUCKET_DIGESTS))
    middle = 0 if low is None else (low + high) // 2
    old = F.col("doc_id").isNull() | (F.col("doc_id") <= middle)
    index = build_index(rows.where(old), buckets)
    totals = scratch(lookup(index, rows.where(~old), buckets), "digest-totals")
    repeated = totals.where("group_size > 1").select("digest", "keep_id", "group_size")
    found = attach(rows, repeated, "digest", "group_size", total)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", *carry, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
