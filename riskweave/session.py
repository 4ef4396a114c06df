"""Session helpers: one place for the configuration every job and test relies on.

The library never creates a session behind the caller's back; functions take the
``DataFrame`` they work on and use its ``sparkSession``. ``get_session`` is for
tests, the benchmark and command-line jobs.
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid

from pyspark.sql import SparkSession

# Settings the engine assumes. AQE re-plans joins (runtime broadcast of small
# materialised sides, skew-join splitting) and coalesces small shuffle outputs.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files of frames that are no longer referenced are deleted
    # (the engine checkpoints narrow sorts and per-round graph labels)
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "riskweave", extra: dict | None = None) -> SparkSession:
    """Build (or return) a session with the engine's settings."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder; it is read from
    the session and used as is. Only when it is unset a fresh folder below the
    session's warehouse is used, which every executor sees too; a local run
    deletes it at its end.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        configured = f"{warehouse}/_scratch-{uuid.uuid4().hex}"
        if sc.master.startswith("local["):
            atexit.register(shutil.rmtree, configured.removeprefix("file:"), ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
