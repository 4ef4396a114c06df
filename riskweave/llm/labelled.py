"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, scratch, text_or_empty

_BUCKETS = 1 << 30


def hash_share(share: float, seed: int, *cols: str) -> Column:
    """True for about ``share`` of all keys, chosen by a hash of ``cols`` and ``seed``."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(_BUCKETS)) < int(min(1.0, share) * _BUCKETS)


#: Parts that a sample is dealt into: 0 to 3 for learning, the last for the calibration.
PARTS = 5
#: A class with fewer rows than SHARED is shared by all learning parts, one with fewer than LEAST also by the calibration.
SHARED, LEAST = 10 * PARTS, 2 * PARTS
#: A class gets at least this share of the sample, or all its rows.
LEAST_SHARE = 0.1


@dataclass
class Sample:
    rows: DataFrame  # text, y, w, parts
    base: float  # share of y = 1 among all usable labels
    both: bool  # whether both classes have usable labels

    def part(self, *parts: int) -> DataFrame:
        """The rows that belong to any of ``parts``, once each."""
        return self.rows.where(F.arrays_overlap("parts", F.array(*[F.lit(p) for p in parts])))


def _parts(rank: int, size: int) -> list[int]:
    """Parts of a class's row by its rank among the ``size`` sampled rows of the class."""
    if size < LEAST:
        return [*range(PARTS)]
    if size < SHARED and rank % PARTS != PARTS - 1:
        return [*range(PARTS - 1)]
    return [rank % PARTS]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int,
                    seed: int = 17) -> Sample:
    """About ``rows`` training documents with their label, whole texts: (text, y, w, parts).

    Rows whose crc32(doc_id) mod ``modulus`` is ``held`` are never used, nor are
    rows without id, label or document. Which rows are taken depends on a hash of the id
    and the class: all classes have the same share, but a rare one is taken whole or up to
    ``LEAST_SHARE * rows``. ``w`` gives each class the weight it has among all usable labels.
    ``parts`` deals each class by rank for separate fitting steps, so a class is in every part
    as long as it has a usable row at all; a class of few rows serves several steps. The sampled
    ids are at most a few more than ``rows * (1 + LEAST_SHARE)``; the driver deals them and they are broadcast to one scan of the texts.
    """
    ids = F.col("doc_id").cast("long").alias("doc_id")
    usable = scratch(labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", modulus) != held))
                     .groupBy(ids).agg(F.max(F.col(label).cast("int")).alias("y"))
                     .join(docs.select(ids), "doc_id", "left_semi"), f"labels-{label}")
    sizes = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    n = sum(sizes.values())
    taken = [F.when((F.col("y") == y) & hash_share(max(rows / n, LEAST_SHARE * rows / size), seed, "doc_id"), True)
             for y, size in sizes.items()]
    found = usable.where(F.coalesce(*taken, F.lit(False))).select("y", F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").collect()
    by_class: dict[int, list[int]] = {}
    for y, _, i in sorted(map(tuple, found)):
        by_class.setdefault(y, []).append(i)
    dealt = [(i, y, sizes[y] / n * len(found) / len(members), _parts(rank, len(members)))
             for y, members in by_class.items() for rank, i in enumerate(members)]
    dealt = docs.sparkSession.createDataFrame(dealt, "doc_id long, y int, w double, parts array<int>")
    joined = docs.select(ids, text_or_empty().alias("text")).join(F.broadcast(dealt), "doc_id")
    return Sample(scratch(joined.select("text", "y", "w", "parts"), f"sample-{label}"),
                  sum(size for y, size in sizes.items() if y > 0) / max(n, 1), len(by_class) > 1)
