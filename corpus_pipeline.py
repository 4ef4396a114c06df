"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, secret scan, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; ``run`` writes each stage's rows to the shared folder and reads them back
for the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import exact_dedup, langid, packing, secrets, simhash_dedup
from riskweave.llm.common import drop_scratch, read_table, scratch, text_or_empty

SHINGLE, RADIUS = 4, 4


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has (Spark does not tell cases apart)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language (no text, no letter) go; a missing ``lang`` is filled in."""
    label, found = langid.predictor(langid.fit(docs), once=True), _fresh(docs, "found")
    columns = [F.coalesce("lang", f"{found}.lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns]
    return docs.withColumn(found, label("text")).where(F.col(f"{found}.lang_pred") != langid.UNKNOWN).select(*columns)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row_sha): rows are told apart by id and text, as ids may be missing or repeated."""
    return docs.select("doc_id", "text", F.sha2(text_or_empty(), 256).alias("row_sha"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, row_sha) is in ``gone``; of rows alike in both one stays."""
    columns, sha = docs.columns, _fresh(docs, "row_sha")
    keyed = docs.withColumn(sha, F.sha2(text_or_empty(), 256))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("row_sha").alias("gone_sha")).distinct()
    kept = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["gone_id"]) & (keyed[sha] == gone["gone_sha"]), "left_anti")
    again = scratch(keyed.groupBy("doc_id", sha).count().where("count > 1").select(
        F.col("doc_id").alias("again_id"), F.col(sha).alias("again_sha")), "repeated-rows")
    if not again.limit(1).count():
        return kept.select(*columns)
    repeated = kept["doc_id"].eqNullSafe(again["again_id"]) & (kept[sha] == again["again_sha"])
    once = kept.join(again, repeated, "left_anti")
    first = kept.join(again, repeated, "left_semi").dropDuplicates(["doc_id", sha])
    return once.unionByName(first).select(*columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: the largest doc_id (rows without id lose), of several rows with it (or
    without any id) the one with the smallest digest of its whole text."""
    decided = exact_dedup.exact_duplicates(_rows(docs), carry=("row_sha",))
    # rows of one group that would all stay: one id with texts that differ in case, or no id at all
    staying = scratch(decided.where("kept AND group_size > 1").select("doc_id", "row_sha", "text_sha256").distinct(), "staying")
    first = staying.groupBy("text_sha256").agg(F.min("row_sha").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    tied = staying.join(first, "text_sha256").where(F.col("row_sha") != F.col("first"))
    return _without(docs, decided.where("NOT kept").select("doc_id", "row_sha").unionByName(tied.select("doc_id", "row_sha")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row stays: the smallest doc_id (rows without id lose), of several
    rows with it (or without any id) the one with the smallest digest of its whole text."""
    rows = _rows(docs)
    # a name that orders rows by these rules takes the place of the id
    named = rows.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_sha").alias("doc_id"), "text")
    groups = simhash_dedup.near_duplicates(named, SHINGLE, RADIUS)
    return _without(docs, groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id.doc_id", "doc_id.row_sha"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; no document goes, texts without secrets are unchanged.

    Weak parts that reach beyond a base span are masked too (an endpoint with a password in its query)."""
    # the scan adds columns of its own: those of docs take plain names meanwhile
    names = {c: "text" if c == "text" else f"column {i}" for i, c in enumerate(docs.columns)}
    scanned = secrets.scan(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), overlapping=True)
    clean, found = secrets.redact(F.col("text"), F.col("spans")), F.size("spans") > 0
    values = {"text": clean, "n_chars": F.when(found, F.char_length(clean).cast("long")).otherwise(F.col(f"`{names.get('n_chars', 'text')}`"))}
    return scanned.select(*[values.get(c, F.col(f"`{n}`")).alias(c) for c, n in names.items()])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per bin with the ids and pieces it holds."""
    return packing.best_fit_packing(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near),
          ("secret_scan", secret_scan), ("best_fit_packing", pack)]

#: Trained models, iterated components and bin packing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            drop_scratch(last)
        last = docs
    return docs
