"""Models re-aimed at ``pyspark.ml`` (plus two distributed anomaly scorers).

* M1 class weights, M2 boosted trees (three presets of ``GBTClassifier``),
  M3 importances.
* M4 isolation forest as a Spark job: every tree gets its own seeded random
  sample of ``rows_per_tree`` rows (a bounded group), trees are built
  with ``groupBy(tree).applyInPandas`` (numpy), the forest (bounded: trees x
  nodes) is broadcast and rows are scored by an Arrow ``pandas_udf``.
* M5 reconstruction error of a PCA fitted on negatives (linear stand-in for
  the autoencoder): ``||x||^2 - ||P^T x||^2`` with orthonormal components.
* M6 min-max scaling by the 1st/99th percentile of the training scores.
* M7 out-of-fold scores (P4 folds), M8 logistic meta-learner, M9 isotonic
  calibration, M10 ensemble scoring, M11 threshold prediction. M12 is in
  ``plans/search.py``, M13 in ``plans/training.py``.
"""

from __future__ import annotations

import json
import math
import threading
from dataclasses import dataclass, field
from functools import partial
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression,
                                       LogisticRegressionModel)
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators import evaluate as E
from ..operators.ordering import quantiles
from ..operators.split import stratified_folds
from ..sources.scratch import MAX_AT_ONCE, materialise, side_by_side

# Booster presets (depth / learning rate / row and column subsampling).
# (leaf minimums: 10 rows for the first preset, 50 for the leaf-wise one; 63 leaves ~ depth 6)
GBT_PRESETS = {
    "xgboost": dict(maxDepth=6, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=10),
    "lightgbm": dict(maxDepth=6, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=50),
    "catboost": dict(maxDepth=6, stepSize=0.05, subsamplingRate=1.0, featureSubsetStrategy="all"),
}


def p1(df: DataFrame, label: str = "label") -> float:
    return df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0


def class_weights(df: DataFrame, label: str = "label", weight_col: str = "weight") -> DataFrame:
    """M1: positives weighted (1 - p) / p, negatives 1."""
    p = p1(df, label)
    w = (1 - p) / p if p > 0 else 1.0
    return df.withColumn(weight_col, F.when(F.col(label) == 1, F.lit(w)).otherwise(F.lit(1.0)))


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def positive_probability(pred: DataFrame, col: str = "probability") -> F.Column:
    return vector_to_array(F.col(col))[1]


def fit_gbt(train: DataFrame, preset: str = "xgboost", label: str = "label", features: str = "features",
            max_iter: int = 50, seed: int = 42, validation: DataFrame | None = None, weighted: bool = True,
            rows_per_task: int | None = None):
    """M2: a boosted-tree classifier with class weights; with ``validation`` rows the
    rounds stop once their loss no longer improves (``validationTol``).

    ``rows_per_task`` merges small partitions into tasks of about that many rows (none is split): a level of a tree is
    a job of two short stages, whose tasks cost more to start than to run when they have few rows."""
    data = class_weights(train, label) if weighted else train
    if validation is not None:
        cols = [label, features] + (["weight"] if weighted else [])
        held = class_weights(validation, label) if weighted else validation
        data = data.select(*cols, F.lit(False).alias("_held")).unionByName(held.select(*cols, F.lit(True).alias("_held")))
    params = dict(GBT_PRESETS[preset])
    gbt = GBTClassifier(labelCol=label, featuresCol=features, maxIter=max_iter, seed=seed,
                        weightCol="weight" if weighted else None, **params)
    if validation is not None:
        gbt = gbt.setValidationIndicatorCol("_held")
    if rows_per_task is not None:
        data = data.coalesce(max(1, -(-data.count() // rows_per_task)))
    return gbt.fit(data)


def feature_importance(model, names: Sequence[str]) -> DataFrame:
    """M3: (feature, importance) sorted descending."""
    from pyspark.sql import SparkSession
    imp = model.featureImportances.toArray().tolist()
    s = SparkSession.getActiveSession()
    return s.createDataFrame(list(zip(names, [float(x) for x in imp])), "feature string, importance double") \
        .orderBy(F.desc("importance"), "feature")


def score_with(model, df: DataFrame, out: str) -> DataFrame:
    pred = model.transform(df)
    return pred.withColumn(out, positive_probability(pred)).drop("rawPrediction", "probability", "prediction")


# ---------------------------------------------------------------- M6

def minmax_bounds(df: DataFrame, col: str) -> tuple[float, float]:
    lo, hi = quantiles(df, [col], [0.01, 0.99])[col]
    return lo, hi


def minmax(col: str, lo: float, hi: float) -> F.Column:
    """M6: (x - p1) / (p99 - p1) clipped to [0, 1]; NULL stays NULL, no spread counts as 1e-9."""
    if lo is None or hi is None:
        return F.lit(None).cast("double")
    scaled = (F.col(col) - F.lit(lo)) / F.lit(max(hi - lo, 1e-9))
    return F.when(F.col(col).isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))


# ---------------------------------------------------------------- M4 isolation forest

def unsuccessful_search(n) -> np.ndarray:
    """Average path length of an unsuccessful search in a binary search tree of n keys."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1),
                    np.where(n == 2, 1.0, 0.0))


def typical_path(sample_size: int) -> float:
    return max(float(unsuccessful_search(sample_size)), 1.0)


def _walkable(tree: pd.DataFrame) -> tuple:
    """(feature, split, children, path length, levels) of one tree's nodes in order. Node i's left child is at 2 i of
    the children, its right one at 2 i + 1; a leaf leads to itself, so all rows take the same number of steps."""
    feat, left, right = (tree[c].to_numpy().astype(int) for c in ("feat", "left", "right"))
    depth = np.zeros(len(tree))
    for i in np.flatnonzero(feat >= 0):                      # parents come before their children
        depth[[left[i], right[i]]] = depth[i] + 1
    leaf, here = feat < 0, np.arange(len(tree))
    child = np.stack([np.where(leaf, here, left), np.where(leaf, here, right)], axis=1).ravel()
    return np.where(leaf, 0, feat), tree["split"].to_numpy(), child, depth + unsuccessful_search(tree["size"].to_numpy()), int(depth.max())


@dataclass
class IsolationForestModel:
    trees: pd.DataFrame         # tree, node, feat, split, left, right, size (small: trees x nodes)
    n_features: int
    sample_size: int
    lo: float = 0.0
    hi: float = 1.0

    def raw_score(self, df: DataFrame, features: str = "features", out: str = "if_raw") -> DataFrame:
        c_psi = typical_path(self.sample_size)
        # the forest (trees x nodes, bounded) travels with the function
        forest = [_walkable(t) for _, t in self.trees.sort_values(["tree", "node"]).groupby("tree")]

        @F.pandas_udf(DoubleType())
        def path_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                X = np.vstack(x.to_numpy()) if len(x) else np.zeros((0, 1))
                n = len(X)
                values, rows = X.T.ravel(), np.arange(n)     # feature after feature
                total = np.zeros(n)
                for feat, split, child, length, levels in forest:
                    start = feat * n
                    node = np.zeros(n, dtype=int)
                    for _ in range(levels):
                        right = ~(values[start[node] + rows] < split[node])
                        node = child[2 * node + right]
                    total += length[node]
                yield pd.Series(np.power(2.0, -total / max(len(forest), 1) / c_psi))

        arr = df.withColumn("_x", vector_to_array(F.col(features)))
        return arr.withColumn(out, path_score(F.col("_x"))).drop("_x")

    def score(self, df: DataFrame, features: str = "features", out: str = "if_score") -> DataFrame:
        return self.raw_score(df, features, "_raw").withColumn(out, minmax("_raw", self.lo, self.hi)).drop("_raw")


def fit_isolation_forest(df: DataFrame, features: str = "features", n_trees: int = 200, rows_per_tree: int = 256,
                         seed: int = 42, key: str = "id") -> IsolationForestModel:
    """M4: each tree is grown on its own random sample in one pandas task.

    ``rows_per_tree`` is a number of rows, the same at every table size (all rows
    of a smaller table); a tree's rows are distinct and chosen by hashes of key,
    tree and seed, whatever the partitioning. Feature standardisation is skipped: splits are
    drawn uniformly within each feature's range, so scaling does not change the trees.
    """
    if isinstance(rows_per_tree, bool) or not isinstance(rows_per_tree, int) or rows_per_tree < 2:
        raise ValueError("rows_per_tree must be a whole number of rows, at least 2")
    arr = df.select(key, vector_to_array(F.col(features)).alias("x"))
    n = df.count()
    if not n:
        raise ValueError("an isolation forest needs training rows")
    psi = max(2, min(rows_per_tree, n))
    # the trees draw from a pool of as many rows as all samples have together, chosen by one hash per row; only
    # pool rows are hashed per tree: about 4 * psi of a tree's hashes lie below the bound, its psi smallest are the sample
    span = 1 << 40
    pool = min(n, n_trees * psi)
    if n > 2 * pool:
        arr = arr.where(F.pmod(F.xxhash64(F.col(key), F.lit(~seed)), F.lit(span)) < int(pool / n * span))
    else:
        pool = n
    arr = materialise(arr, "forest-input")      # the pool only
    bound = int(min(1.0, 4.0 * psi / pool + 1e-9) * span)
    # exploded before the filter: a filter inside the array is evaluated without generated code
    picked = (arr.select(key, "x", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
              .withColumn("_r", F.pmod(F.xxhash64(F.col(key), F.col("tree"), F.lit(seed)), F.lit(span)))
              .where(F.col("_r") < bound))
    max_depth = int(np.ceil(np.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_r", key]).head(psi)
        X = np.vstack(pdf["x"].to_numpy())
        rng = np.random.default_rng(abs(int(pdf["tree"].iloc[0])) + seed)
        rows = []

        def build(idx, depth):
            nid = len(rows)
            rows.append([nid, -1, 0.0, -1, -1, len(idx)])
            if depth >= max_depth or len(idx) <= 1:
                return nid
            sub = X[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            cand = np.where(hi > lo)[0]
            if len(cand) == 0:
                return nid
            f = int(rng.choice(cand))
            s = float(rng.uniform(lo[f], hi[f]))
            mask = sub[:, f] < s
            rows[nid][1], rows[nid][2] = f, s
            rows[nid][3] = build(idx[mask], depth + 1)
            rows[nid][4] = build(idx[~mask], depth + 1)
            return nid

        build(np.arange(len(X)), 0)
        out = pd.DataFrame(rows, columns=["node", "feat", "split", "left", "right", "size"])
        out.insert(0, "tree", int(pdf["tree"].iloc[0]))
        return out

    schema = "tree int, node int, feat int, split double, left int, right int, size int"
    forest = picked.groupBy("tree").applyInPandas(grow, schema).toPandas()   # trees x nodes: bounded
    n_feat = len(arr.select("x").first()[0])
    model = IsolationForestModel(forest, n_feat, psi)
    model.lo, model.hi = minmax_bounds(model.raw_score(df, features, "_raw"), "_raw")
    return model


# ---------------------------------------------------------------- M5 reconstruction error

# PCA ends with a small decomposition in the driver's JVM, which failed to converge when several fits reached it at once.
_ONE_PCA = threading.Lock()


@dataclass
class ReconstructionModel:
    pca: object
    mean: list
    std: list
    d: int
    lo: float = 0.0
    hi: float = 1.0

    def raw_score(self, df: DataFrame, features: str = "features", out: str = "ae_raw") -> DataFrame:
        mean, std, components, d = np.array(self.mean), np.array([s or 1.0 for s in self.std]), self.pca.pc.toArray(), self.d

        @F.pandas_udf(DoubleType())
        def residual_energy(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                z = (np.vstack(x.to_numpy()) - mean) / std if len(x) else np.zeros((0, d))
                rest = (z * z).sum(axis=1) - ((z @ components) ** 2).sum(axis=1)
                yield pd.Series(np.maximum(rest, 0.0) / d)

        # NaN leaves an Arrow UDF as NULL
        energy = F.coalesce(residual_energy(F.col("_x")), F.lit(float("nan")))
        return df.withColumn("_x", vector_to_array(F.col(features))).withColumn(out, energy).drop("_x")

    def score(self, df: DataFrame, features: str = "features", out: str = "ae_score") -> DataFrame:
        return self.raw_score(df, features, "_raw").withColumn(out, minmax("_raw", self.lo, self.hi)).drop("_raw")


def fit_reconstruction(df: DataFrame, features: str = "features", label: str = "label", k: int = 8):
    """M5: standardise on negatives (population std), PCA(k); error = residual energy / d."""
    neg = df.where(F.col(label) == 0)
    one = neg.select(features).first()
    if one is None:
        raise ValueError("a reconstruction model needs training rows with label 0")
    d = len(one[0])
    # vectors throughout: an expression per element makes very large generated code, which ran slowly per row.
    # The scaler divides by the sample's std; that stretches all axes alike, so the components are those of the population's
    scaler = StandardScaler(withMean=True, withStd=True, inputCol=features, outputCol="_z").fit(neg)
    n = neg.count()
    mean, std = scaler.mean.toArray().tolist(), [s * math.sqrt((n - 1) / n) if s else 1.0 for s in scaler.std.toArray().tolist()]
    with _ONE_PCA:
        pca = PCA(k=min(k, d), inputCol="_z", outputCol="_pc").fit(scaler.transform(neg))
    model = ReconstructionModel(pca, mean, std, d)
    model.lo, model.hi = minmax_bounds(model.raw_score(neg, features, "_raw"), "_raw")
    return model


# ---------------------------------------------------------------- M7-M10 stacking

@dataclass
class Ensemble:
    base: dict                      # name -> fitted model (GBT or anomaly model)
    meta: object                    # LogisticRegressionModel on the base scores
    calibrator: object | None       # IsotonicRegressionModel
    names: list = field(default_factory=list)
    oof_means: dict = field(default_factory=dict)   # mean out-of-fold score of every base model

    def save(self, path: str) -> None:
        """IO6: every base model, the meta-learner and the calibration."""
        for name, model in {**self.base, "_meta": self.meta, "_calibrator": self.calibrator}.items():
            save_model(model, f"{path}/{name}")
        spark = SparkSession.getActiveSession()
        note = json.dumps({"names": self.names, "oof_means": self.oof_means})
        spark.createDataFrame([(note,)], "note string").coalesce(1).write.mode("overwrite").json(f"{path}/ensemble")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Ensemble":
        note = json.loads(spark.read.json(f"{path}/ensemble").first()["note"])
        base = {n: load_model(spark, f"{path}/{n}") for n in note["names"]}
        return Ensemble(base, load_model(spark, f"{path}/_meta"), load_model(spark, f"{path}/_calibrator"),
                        note["names"], note["oof_means"])

    def base_scores(self, df: DataFrame, features: str = "features") -> DataFrame:
        out = df
        for name in self.names:
            out = _score_base(self.base[name], out, name, features)
        return out

    def score(self, df: DataFrame, features: str = "features", out: str = "score") -> DataFrame:
        """Base scores -> meta probability -> isotonic calibration."""
        b = self.base_scores(df, features)
        b = VectorAssembler(inputCols=self.names, outputCol="_meta").transform(b)
        m = self.meta.transform(b)
        m = m.withColumn("meta_score", positive_probability(m)).drop("rawPrediction", "probability", "prediction")
        if self.calibrator is not None:
            m = self.calibrator.transform(m).withColumnRenamed("_iso", out)
        else:
            m = m.withColumn(out, F.col("meta_score"))
        return m.drop("_meta")


def save_model(model, path: str) -> None:
    """A fitted base model (trees, anomaly model) or None under ``path``, with a note of its kind."""
    spark = SparkSession.getActiveSession()
    note: dict = {"kind": type(model).__name__}
    if isinstance(model, IsolationForestModel):
        spark.createDataFrame(model.trees).write.mode("overwrite").parquet(f"{path}/trees")
        note |= {"n_features": model.n_features, "sample_size": model.sample_size, "lo": model.lo, "hi": model.hi}
    elif isinstance(model, ReconstructionModel):
        model.pca.write().overwrite().save(f"{path}/pca")
        note |= {"mean": model.mean, "std": model.std, "d": model.d, "lo": model.lo, "hi": model.hi}
    elif model is not None:
        model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(note),)], "note string").coalesce(1).write.mode("overwrite").json(f"{path}/note")


def load_model(spark: SparkSession, path: str):
    note = json.loads(spark.read.json(f"{path}/note").first()["note"])
    kind = note.pop("kind")
    if kind == "NoneType":
        return None
    if kind == "IsolationForestModel":
        trees = spark.read.parquet(f"{path}/trees").orderBy("tree", "node").toPandas()     # trees x nodes: bounded
        return IsolationForestModel(trees, **note)
    if kind == "ReconstructionModel":
        return ReconstructionModel(PCAModel.load(f"{path}/pca"), **note)
    known = {m.__name__: m for m in (GBTClassificationModel, LogisticRegressionModel, IsotonicRegressionModel)}
    return known[kind].load(f"{path}/model")


def _score_base(model, df, name, features):
    if isinstance(model, (IsolationForestModel, ReconstructionModel)):
        return model.score(df, features, name)
    return score_with(model, df, name)


# The many fits of one training job already run side by side, so a fit gains little from tasks of fewer rows.
ROWS_PER_TASK = 200_000


def _fit_base(kind: str, train: DataFrame, max_iter: int, seed: int, val: DataFrame | None = None):
    if kind in GBT_PRESETS:
        return fit_gbt(train, kind, max_iter=max_iter, seed=seed, validation=val, rows_per_task=ROWS_PER_TASK)
    if kind == "isolation_forest":
        return fit_isolation_forest(train, seed=seed)
    if kind == "reconstruction":
        return fit_reconstruction(train)
    raise ValueError(kind)


# Fits of few rows wait for the scheduling of their jobs more than for the tasks, and keep little: more of them run at once.
FEW_ROWS, FEW_ROWS_AT_ONCE = 200_000, 12


def _at_once(rows: DataFrame) -> int:
    return FEW_ROWS_AT_ONCE if rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS else MAX_AT_ONCE


def _fold_fits(df: DataFrame, kinds: Sequence[str], k: int, max_iter: int, seed: int) -> tuple[DataFrame, list]:
    """The rows with their fold, and per fold and kind the fit on the other folds, still to be run."""
    folded = materialise(stratified_folds(df, k, "label", seed), "folds")
    return folded, [partial(_fit_base, kind, folded.where(F.col("fold") != f), max_iter, seed) for f in range(k) for kind in kinds]


def _fold_scores(folded: DataFrame, kinds: Sequence[str], k: int, fitted: Sequence) -> DataFrame:
    parts = []
    for f in range(k):
        scored = folded.where(F.col("fold") == f)
        for kind, model in zip(kinds, fitted[f * len(kinds):]):
            scored = _score_base(model, scored, kind, "features")
        parts.append(scored.select("id", "label", "fold", *kinds))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialise(out, "oof")


def oof_scores(df: DataFrame, kinds: Sequence[str], k: int = 3, max_iter: int = 20, seed: int = 42) -> DataFrame:
    """M7: per fold, fit every base model on the other folds and score the fold; union of folds.

    The fits do not depend on each other and run side by side: a boosted-tree fit is hundreds of short jobs."""
    folded, fits = _fold_fits(df, kinds, k, max_iter, seed)
    return _fold_scores(folded, kinds, k, side_by_side(df.sparkSession, fits, _at_once(folded)))


def fit_meta(oof: DataFrame, names: Sequence[str], C: float = 1.0):
    """M8: L2 logistic regression on the OOF scores (sklearn's C -> regParam = 1 / (C n))."""
    n = oof.count()
    data = VectorAssembler(inputCols=list(names), outputCol="_meta").transform(oof)
    lr = LogisticRegression(featuresCol="_meta", labelCol="label", regParam=1.0 / (C * max(n, 1)),
                            elasticNetParam=0.0, standardization=False, maxIter=500)
    return lr.fit(data)


def fit_isotonic(scored: DataFrame, score: str = "meta_score", label: str = "label"):
    """M9: isotonic regression of the label on the meta score (clipped outside the fitted range).

    Rows with the same score are one weighted point (a partial aggregation); no score is rounded. Spark's
    fit range-partitions the points, pools adjacent violators inside each partition and
    gathers the pooled blocks only, whose number grows with about the two-thirds power of the rows: the means
    of successive blocks of 0/1 labels are rising fractions. Rows without a score or label say nothing.
    """
    known = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    points = known.groupBy(F.col(score).cast("double").alias(score)).agg(
        F.avg(F.col(label).cast("double")).alias(label), F.count(F.lit(1)).cast("double").alias("_w"))
    return IsotonicRegression(featuresCol=score, labelCol=label, weightCol="_w", predictionCol="_iso").fit(points)


def fit_ensemble(train: DataFrame, val: DataFrame | None, kinds: Sequence[str], k: int = 3, max_iter: int = 20,
                 seed: int = 42) -> Ensemble:
    """M7-M9: OOF scores -> meta-learner -> final base models on all rows -> isotonic on validation.

    The fits of the folds and the final ones run side by side."""
    kinds = list(kinds)
    folded, fits = _fold_fits(train, kinds, k, max_iter, seed)
    final = [partial(_fit_base, kind, train, max_iter, seed, val) for kind in kinds]
    fitted = side_by_side(train.sparkSession, [*fits, *final], _at_once(folded))
    oof = _fold_scores(folded, kinds, k, fitted[:len(fits)])
    meta = fit_meta(oof, kinds)
    means = dict(zip(kinds, oof.agg(*[F.avg(x) for x in kinds]).first()))
    base = dict(zip(kinds, fitted[len(fits):]))
    ens = Ensemble(base, meta, None, kinds, means)
    calib_src = val if val is not None else train
    b = ens.base_scores(calib_src)
    b = VectorAssembler(inputCols=kinds, outputCol="_meta").transform(b)
    m = meta.transform(b)
    m = m.withColumn("meta_score", positive_probability(m))
    # the fit reads its rows several times: scored once
    ens.calibrator = fit_isotonic(materialise(m.select("meta_score", "label"), "calibration-input"))
    return ens


def predict(df: DataFrame, score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Label prediction score >= threshold."""
    return df.withColumn("prediction", (F.col(score) >= F.lit(threshold)).cast("int"))
