"""IO1-IO6: scans and sinks.

* IO1 raw CSV scan: every column read as string (no inference pass), header
  names matched against an allow-list; unknown columns are ignored, missing
  ones tolerated. The CSV reader prunes columns that are not selected. A second
  reader takes files with differing headers and routes ragged lines to rejects.
* IO2 exact-size seeded sample: the n rows with the smallest seeded hash,
  cut at the exact rank-n boundary found by G1 order statistics.
* IO3/IO4 scored-pairs sink and scan (Parquet by default, CSV with header
  when asked); a missing path reads as an empty frame with the schema.
* IO5 metric reports: long-form (model, metric, value) rows, written as JSON
  lines; nested reports via ``to_json(struct(...))``.

Scratch outputs go under the session's reliable checkpoint directory (a
shared folder on a cluster), never a machine-local temp folder.
"""

from __future__ import annotations

import csv
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.exprs import to_double
from ..session import ensure_checkpoint_dir
from .scratch import materialise

# The 30 application columns read from a raw export.
APPLICATION_COLUMNS = (
    "id", "issue_d", "loan_amnt", "term", "int_rate", "installment", "grade", "sub_grade", "emp_title",
    "emp_length", "home_ownership", "annual_inc", "verification_status", "purpose", "title", "zip_code",
    "addr_state", "dti", "delinq_2yrs", "earliest_cr_line", "inq_last_6mths", "open_acc", "pub_rec",
    "revol_bal", "revol_util", "total_acc", "mort_acc", "pub_rec_bankruptcies", "loan_status", "last_pymnt_d",
)

PREDICTION_SCHEMA = "id long, y_true int, proba double"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/riskweave-{name}-{uuid.uuid4().hex}"


def read_raw_csv(spark: SparkSession, path: str, allow: tuple[str, ...] = APPLICATION_COLUMNS,
                 multi_line: bool = False) -> DataFrame:
    """IO1: header CSV, all strings, only allow-listed columns (in allow-list order).

    A quote inside a quoted field is written twice. ``multi_line`` allows line
    breaks inside quotes, but then a file is read by one task.
    """
    df = (spark.read.option("header", True).option("inferSchema", False).option("escape", '"')
          .option("multiLine", multi_line).option("mode", "PERMISSIVE").csv(path))
    keep = [c for c in allow if c in df.columns]
    return df.select(*keep)


REJECT_SCHEMA = "file string, line string, reason string, parsed int"


def read_csv_with_rejects(spark: SparkSession, path: str, allow: tuple[str, ...] = APPLICATION_COLUMNS,
                          required: tuple[str, ...] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """IO1 over a folder of files that need not agree: (accepted rows, rejected lines with file and reason).

    Every file is read by its own header, so columns may come in another order or be missing. Lines with
    more or fewer fields than their header are rejected ("fields", ``parsed`` of them filled), files whose header lacks a
    required column are rejected whole ("header"). Accepted plus rejected are all lines but headers and blank ones;
    columns of the allow-list that a file lacks are NULL. Quotes as in ``read_raw_csv``; no line breaks inside quotes.
    The driver sees one header line per file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    headers = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header")).collect()
    by_header: dict[str, list[str]] = {}
    for r in sorted(headers, key=lambda r: r["file"]):
        by_header.setdefault(r["header"], []).append(r["file"])

    accepted = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in allow))
    rejected = spark.createDataFrame([], REJECT_SCHEMA)
    for header, files in by_header.items():
        names = [n.strip() for n in next(csv.reader([header]), [])]
        if not set(required) <= set(names) or len(set(names)) < len(names):
            rows = spark.read.option("header", False).text(files).select(
                F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), F.lit("header").alias("reason"), F.lit(0).alias("parsed"))
            rejected = rejected.unionByName(rows.where((F.col("line") != header) & (F.trim("line") != "")))
            continue
        schema = StructType([StructField(n, StringType()) for n in names] + [StructField("_line", StringType())])
        read = (spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", "_line").csv(files))
        present = [c for c in allow if c in names]
        # parsed once: Spark does not answer queries that need nothing but the record column from raw files
        parsed = materialise(read.select(
            *present, F.col("_line").alias("_line"), F.col("_metadata.file_path").alias("_file"),
            sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0)).alias("_parsed")), "csv-parsed")
        accepted = accepted.unionByName(parsed.where("_line IS NULL").select(*present), allowMissingColumns=True)
        rejected = rejected.unionByName(parsed.where("_line IS NOT NULL").select(
            F.col("_file").alias("file"), F.col("_line").alias("line"), F.lit("fields").alias("reason"), F.col("_parsed").alias("parsed")))
    return accepted, rejected


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def typed_applications(df: DataFrame) -> DataFrame:
    """Normalised text columns -> the typed application frame: id a long, numeric columns doubles.

    What does not convert becomes NULL (``validate`` on the text frame reports it).
    """
    numeric = {"loan_amnt", "installment", "annual_inc", "dti", "delinq_2yrs", "inq_last_6mths", "open_acc", "pub_rec",
               "revol_bal", "total_acc", "mort_acc", "pub_rec_bankruptcies"}
    return df.select(*[F.col(c).cast("string").try_cast("bigint").alias(c) if c == "id"
                       else to_double(c).alias(c) if c in numeric else F.col(c) for c in df.columns])


def seeded_sample(df: DataFrame, n: int | None, seed: int = 42, key: str = "id") -> DataFrame:
    """IO2: exactly ``min(n, rows)`` rows without replacement, reproducible for a seed.

    Rows are ranked by ``(md5(key || ':' || seed), key)``. The rank-``n`` boundary
    comes from the G1 order statistics of that narrow pair (one range sort);
    the sample is then a plain filter, so no task ever merges n rows from every
    partition (as ``orderBy(..).limit(n)`` would for large n).
    """
    from ..operators.ordering import ranked_positions
    if n is None:
        return df
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    total, fetch = ranked_positions(df.select(h.alias("_h"), F.col(key).alias("_k")), ["_h", "_k"])
    if n >= total:
        return df
    b = fetch([int(n) - 1])[int(n) - 1]
    bound = F.struct(F.lit(b["_h"]).alias("_h"), F.lit(b["_k"]).alias("_k"))
    return df.where(F.struct(h.alias("_h"), F.col(key).alias("_k")) <= bound)


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """IO3: scored pairs ``(id, y_true, proba)``."""
    out = df.select(F.col("id").cast("long"), F.col("y_true").cast("int"), F.col("proba").cast("double"))
    w = out.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def read_predictions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """IO4: scored pairs; a missing path gives an empty frame ("no data")."""
    try:
        r = spark.read.schema(PREDICTION_SCHEMA)
        return r.option("header", True).csv(path) if fmt == "csv" else r.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], PREDICTION_SCHEMA)
        raise


def metric_rows(metrics: DataFrame, model: str) -> DataFrame:
    """One-row wide metric frame -> long form (model, metric, value)."""
    cols = [c for c in metrics.columns]
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols]))
    return metrics.select(stacked.alias("m")).select(F.lit(model).alias("model"), "m.metric", "m.value")


def write_report(report: DataFrame, path: str) -> str:
    """IO5: long-form report as JSON lines (one object per row)."""
    report.write.mode("overwrite").json(path)
    return path


def nested_report(report: DataFrame) -> DataFrame:
    """IO5 nested form: one JSON document per model, metrics as an object."""
    return (report.groupBy("model")
            .agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"))
            .select("model", F.to_json(F.struct("model", "metrics")).alias("json")))
