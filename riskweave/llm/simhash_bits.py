"""64-bit SimHash fingerprints by counting signed votes with plain aggregates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two 32-bit counters share a long: bit k in the low half, bit k + 32 in the high half.
_LANES = 0x0000000100000001
_LOW = 0xFFFFFFFF


def vote(hashes: DataFrame, keys: list[str], hash_col: str = "h", out: str = "fp") -> DataFrame:
    """One fingerprint per distinct ``keys``: bit i is 1 when over half of the
    group's hashes have it set. Null hashes cast no vote; no vote gives 0.

    32 sums count all 64 bits (exact up to 2^31 votes per group); partial sums
    form before the shuffle, so one small row per group and task moves.
    """
    h = F.col(hash_col)
    sums = [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES))).alias(f"_s{k}") for k in range(32)]
    counted = hashes.groupBy(*keys).agg(F.count(h).alias("_n"), *sums)

    def bit(i: int) -> Column:
        s = F.coalesce(F.col(f"_s{i % 32}"), F.lit(0).cast("long"))
        lane = F.shiftrightunsigned(s, 32) if i >= 32 else s.bitwiseAND(F.lit(_LOW))
        weight = (1 << i) - (1 << 64 if i == 63 else 0)
        return F.when(lane * 2 > F.col("_n"), F.lit(weight).cast("long")).otherwise(F.lit(0).cast("long"))

    fp = reduce(lambda x, y: x.bitwiseOR(y), [bit(i) for i in range(64)])
    return counted.select(*keys, fp.alias(out))


def hex16(fp: str) -> Column:
    """Sixteen lower-case hex digits of a signed 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(units: int, bits: int, blocks: int) -> list[int]:
    """Bit masks of ``blocks`` runs of neighbouring units (``bits`` bits each), sizes as even as can be."""
    edges = [round(i * units / blocks) for i in range(blocks + 1)]
    return [sum(((1 << bits) - 1) << (bits * u) for u in range(a, b)) for a, b in zip(edges, edges[1:])]


def on_blocks(points: DataFrame, masks: list[int], agree: int) -> DataFrame:
    """(fp, code, ...) -> one row per choice of ``agree`` blocks: own (the blocks' numbers as bits), cell (the code's bits there)."""
    tables = [F.struct(F.lit(sum(1 << g for g in t)).alias("own"),
                       F.col("code").bitwiseAND(F.lit(signed(sum(masks[g] for g in t)))).alias("cell"))
              for t in combinations(range(len(masks)), agree)]
    return points.select("*", F.explode(F.array(*tables)).alias("c")).select(*points.columns, "c.own", "c.cell")


def join_on_blocks(left: DataFrame, right: DataFrame, masks: list[int], agree: int,
                   wanted: Callable[[str, str], Column]) -> DataFrame:
    """(fp, code, ...) of either side -> pairs (a, b) of fps whose codes agree on ``agree`` or more blocks
    and that are ``wanted`` (a condition on the two sides' aliases).

    One table per choice of ``agree`` blocks, keyed by the code's bits in them;
    all tables are one equi-join. A pair that meets in several tables is
    reported by the first only (the one of its lowest common blocks), so nothing
    has to be made distinct afterwards.
    """
    apart = F.col("a.code").bitwiseXOR(F.col("b.code"))
    same = reduce(lambda x, y: x.bitwiseOR(y), [
        F.when(apart.bitwiseAND(F.lit(signed(m))) == 0, F.lit(1 << g)).otherwise(F.lit(0)) for g, m in enumerate(masks)])
    rest = same
    for _ in range(agree):  # clears the lowest set bit
        rest = rest.bitwiseAND(rest - 1)
    pairs = on_blocks(left, masks, agree).alias("a").join(
        on_blocks(right, masks, agree).alias("b"),
        (F.col("a.own") == F.col("b.own")) & (F.col("a.cell") == F.col("b.cell"))
        & wanted("a", "b") & (same.bitwiseXOR(rest) == F.col("a.own")))
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def chain_on_blocks(points: DataFrame, masks: list[int], agree: int, close: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """(fp, code) -> links (a, b) between neighbours in fingerprint order inside every cell, if ``close`` (of codes, then fps).

    At most one link per row and table, however full a cell is.
    """
    order = Window.partitionBy("own", "cell").orderBy("fp")
    seen = on_blocks(points.select("fp", "code"), masks, agree).select(
        "fp", "code", F.lag("fp").over(order).alias("a"), F.lag("code").over(order).alias("a_code"))
    linked = seen.where(F.col("a").isNotNull() & close(F.col("a_code"), F.col("code"), F.col("a"), F.col("fp")))
    return linked.select("a", F.col("fp").alias("b")).distinct()
