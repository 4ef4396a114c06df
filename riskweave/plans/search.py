"""Seeded random search over continuous ranges, as a resumable table of trials.

A trial's parameters follow from seed and trial number alone. Every finished trial is a row of a Parquet table
(one folder per trial), so a search that was interrupted goes on where it stopped and a
longer one keeps the trials it has. A trial that exceeds its time has its Spark jobs cancelled by job group and is
recorded as timed out; one that raises is recorded as failed. Neither is tried again.

Trials run in a few driver threads; the work of each is Spark jobs over the training rows.
"""

from __future__ import annotations

import json
import math
import random
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from . import models as M

TRIALS_SCHEMA = "trial int, params string, status string, pr_auc double, seconds double"


@dataclass(frozen=True)
class Range:
    name: str
    low: float
    high: float
    kind: str = "float"     # or "int", "log" (uniform in the logarithm), "text" (a float that Spark takes as text)

    def draw(self, rng: random.Random):
        if self.kind == "int":
            return rng.randint(int(self.low), int(self.high))
        if self.kind == "log":
            return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))
        value = rng.uniform(self.low, self.high)
        return f"{value:.6f}" if self.kind == "text" else value


# The eight ranges searched (rounds and the two penalties re-aimed at what Spark's trees have).
RANGES = (
    Range("maxDepth", 3, 10, "int"), Range("stepSize", 0.01, 0.2, "log"), Range("maxIter", 10, 40, "int"),
    Range("subsamplingRate", 0.6, 1.0), Range("featureSubsetStrategy", 0.6, 1.0, "text"),
    Range("minInstancesPerNode", 1, 50, "int"), Range("minInfoGain", 0.0, 0.01), Range("minWeightFractionPerNode", 0.0, 0.05),
)


def trial_params(trial: int, seed: int = 42, ranges: Sequence[Range] = RANGES) -> dict:
    rng = random.Random(f"{seed}:{trial}")
    return {r.name: r.draw(rng) for r in ranges}


def boosted_trees_objective(train: DataFrame, val: DataFrame, seed: int = 42) -> Callable[[dict], float]:
    """PR-AUC on ``val`` of a weighted boosted-tree classifier fitted on ``train``, stopping early on ``val``."""
    columns = ["label", "features", "weight"]
    data = M.class_weights(train).select(*columns, F.lit(False).alias("_held")) \
        .unionByName(M.class_weights(val).select(*columns, F.lit(True).alias("_held")))

    def value(params: dict) -> float:
        model = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", validationIndicatorCol="_held",
                              seed=seed, **params).fit(data)
        return E.curve_metrics(E.threshold_table(E.scored_pairs(M.score_with(model, val, "score")))).first()["pr_auc"]
    return value


class TrialTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder_exists(self) -> bool:
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(top)

    def rows(self) -> DataFrame:
        if not self._folder_exists():
            return self.spark.createDataFrame([], TRIALS_SCHEMA)
        return self.spark.read.schema(TRIALS_SCHEMA).parquet(f"{self.path}/*")

    def add(self, trial: int, params: dict, status: str, value: float | None, seconds: float) -> None:
        row = (trial, json.dumps(params, sort_keys=True), status, value, seconds)
        self.spark.createDataFrame([row], TRIALS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{trial}")


def search(spark: SparkSession, objective: Callable[[dict], float], path: str, n_trials: int, seed: int = 42,
           trial_seconds: float | None = None, total_seconds: float | None = None, parallelism: int = 2,
           ranges: Sequence[Range] = RANGES) -> DataFrame:
    """Run what is missing of trials 0 to n - 1 and return the whole table, best first.

    ``trial_seconds`` limits one trial, ``total_seconds`` the time in which trials are begun.
    """
    sc, table = spark.sparkContext, TrialTable(spark, path)
    finished = {r["trial"] for r in table.rows().select("trial").collect()}
    begun = time.monotonic()

    def run(trial: int) -> None:
        if total_seconds is not None and time.monotonic() - begun >= total_seconds:
            return
        group, over, late = f"search-{uuid.uuid4().hex}", threading.Event(), threading.Event()

        def watch() -> None:
            # a fit is many jobs: cancel until the trial has noticed
            if not over.wait(trial_seconds):
                late.set()
                while not over.wait(0.2):
                    sc.cancelJobGroup(group)

        sc.setJobGroup(group, f"trial {trial}", interruptOnCancel=True)
        watcher = threading.Thread(target=watch, daemon=True)
        if trial_seconds is not None:
            watcher.start()
        params, start, value, status = trial_params(trial, seed, ranges), time.monotonic(), None, "done"
        try:
            value = objective(params)
        except Exception:
            status = "failed"
        finally:
            over.set()
            if trial_seconds is not None:
                watcher.join()
        if late.is_set() and value is None:
            status = "timeout"
        sc.setJobGroup(f"{group}-record", f"record trial {trial}")
        table.add(trial, params, status, value, time.monotonic() - start)

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        list(pool.map(inheritable_thread_target(spark)(run), [t for t in range(n_trials) if t not in finished]))
    return table.rows().where(F.col("trial") < n_trials).orderBy(F.desc_nulls_last("pr_auc"), "trial")
