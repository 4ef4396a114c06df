"""Helpers shared by the corpus operators: table scans, text columns, scratch
tables in the shared folder, and joins that survive hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space that separates words: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` equals that on pure ASCII strings, which
    take the fast path; other strings are translated letter by letter."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
        .otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Array of the maximal runs of non-space characters (empty for a blank text)."""
    trimmed = F.btrim(text, F.lit(_SPACES))
    return F.when(F.char_length(trimmed) > 0, F.split(trimmed, SPACE_CLASS)) \
        .otherwise(F.array().cast("array<string>"))


def shingle_rows(word_array: str, k: int, parts: list[str]) -> Column:
    """Array of k-word windows as structs of ``parts`` (one field per word).

    A shorter sequence gives one window: its words, then nulls. No word: empty array.
    """
    w = F.col(word_array)
    n = F.size(w)
    slices = []
    for i in range(k):
        short = F.when(n > i, F.array(F.get(w, F.lit(i)))).otherwise(F.array(F.lit(None).cast("string")))
        slices.append(F.when(n >= k, F.slice(w, F.lit(i + 1), n - (k - 1)))
                      .when(n > 0, short).otherwise(F.array().cast("array<string>")).alias(parts[i]))
    return F.arrays_zip(*slices)


def scratch(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the session's shared checkpoint folder and read it back.

    Cuts the lineage with a table that outlives any executor, keeps column
    pruning, and gives iterative jobs a fixed input.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(df: DataFrame) -> None:
    """Delete a table written by ``scratch`` that no later frame reads."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A key counts as heavy when it holds at least this share of all rows, so there
#: are at most 1/share heavy keys whatever the input.
HEAVY_SHARE = 0.001


def attach(rows: DataFrame, per_key: DataFrame, key: str, count_col: str, total: int) -> DataFrame:
    """Left join ``rows`` with ``per_key`` (one row per key) on ``key``.

    ``count_col`` of ``per_key`` says how many rows carry the key. Keys that
    hold at least ``HEAVY_SHARE`` of the ``total`` rows are at most 1,000, so
    they are broadcast (a proven bound) and never meet in one shuffle task; the
    rest takes an ordinary shuffle join.
    """
    least = max(1000, int(total * HEAVY_SHARE))
    extra = [c for c in per_key.columns if c != key]
    heavy = per_key.where(F.col(count_col) >= least)
    hot = heavy.select(F.col(key), F.lit(True).alias("_hot"), *[F.col(c).alias(f"_h_{c}") for c in extra])
    rest = per_key.where(F.col(count_col) < least).select(
        F.col(key).alias("_light"), *[F.col(c).alias(f"_l_{c}") for c in extra])
    probed = rows.join(F.broadcast(hot), key, "left")

    out = probed.where("_hot IS NOT NULL").select(*[F.col(c) for c in rows.columns],
                                                  *[F.col(f"_h_{c}").alias(c) for c in extra])
    light = probed.where("_hot IS NULL").join(rest, F.col(key) == F.col("_light"), "left") \
        .select(*[F.col(c) for c in rows.columns], *[F.col(f"_l_{c}").alias(c) for c in extra])
    return out.unionByName(light)


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(id_col).cast("string")) % modulus
