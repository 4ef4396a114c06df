"""E11/E12 on applicant features: exact additive contributions of the whole ensemble.

The meta-learner's margin is ``b + sum_k c_k s_k`` over the base scores s_k. Each base score is taken
apart into a base value and one part per feature:

* trees (M2): along a row's path every split changes the expected value from the node's mean to its child's;
  the change goes to the split's feature. Node means start from the root's, so root mean plus all parts is the
  tree's output. The probability 1 / (1 + exp(-2 F)) of the summed output F is bent, so its distance from the base
  probability is dealt over the features in proportion to their parts of F.
* isolation trees (M4): the same with expected path lengths (children weighted by their rows).
* reconstruction error (M5): a sum of squared residuals, one per feature; base 0.

A feature's contribution to the margin is ``sum_k c_k part_k``; base margin plus all contributions is the margin,
up to rounding. Where a model's parts cancel out exactly, its score is its base score and it says nothing.

One Arrow UDF per row batch; the node table (trees x nodes, bounded by the models) is the only thing sent to tasks.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import models as M

cloudpickle.register_pickle_by_value(sys.modules[__name__])      # tasks need the functions below, not the package

PARTS_SCHEMA = "base_margin double, margin double, parts array<double>"


@dataclass
class Tree:
    """Nodes as arrays: split feature (-1: leaf), threshold, children, expected value."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    equal_left: bool = True     # a value equal to the threshold goes left


def path_parts(x: np.ndarray, trees: Sequence[Tree], weights: Sequence[float]) -> tuple[float, np.ndarray]:
    """(base value, rows x features): weighted changes of the expected value along every row's paths."""
    parts = np.zeros(x.shape)
    every = np.arange(len(x))
    base = 0.0
    for tree, weight in zip(trees, weights):
        base += weight * float(tree.value[0])
        node = np.zeros(len(x), int)
        rows = every
        while True:
            rows = rows[tree.feature[node[rows]] >= 0]
            if not len(rows):
                break
            at = node[rows]
            feature = tree.feature[at]
            here, cut = x[rows, feature], tree.threshold[at]
            child = np.where((here <= cut) if tree.equal_left else (here < cut), tree.left[at], tree.right[at])
            parts[rows, feature] += weight * (tree.value[child] - tree.value[at])
            node[rows] = child
    return base, parts


def _rescaled(parts: np.ndarray, reached: np.ndarray, start: float) -> np.ndarray:
    """Parts dealt anew so that each row's add up to ``reached - start``."""
    total = parts.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        factor = np.where(total != 0, (reached - start) / total, 0.0)
    return parts * factor[:, None]


@dataclass
class BoostedTrees:
    trees: list[Tree]
    weights: list[float]

    def parts(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        base, parts = path_parts(x, self.trees, self.weights)
        start = 1 / (1 + np.exp(-2 * base))
        reached = 1 / (1 + np.exp(-2 * (base + parts.sum(axis=1))))
        return float(start), _rescaled(parts, reached, start)


@dataclass
class IsolationTrees:
    trees: list[Tree]
    typical: float
    lo: float
    hi: float

    def _score(self, length: np.ndarray) -> np.ndarray:
        raw = np.power(2.0, -length / max(len(self.trees), 1) / self.typical)
        return np.clip((raw - self.lo) / max(self.hi - self.lo, 1e-9), 0, 1)

    def parts(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        base, parts = path_parts(x, self.trees, [1.0] * len(self.trees))
        start = float(self._score(np.array([base]))[0])
        return start, _rescaled(parts, self._score(base + parts.sum(axis=1)), start)


@dataclass
class Residuals:
    mean: np.ndarray
    std: np.ndarray
    components: np.ndarray      # features x k, orthonormal
    lo: float
    hi: float

    def _score(self, error: np.ndarray) -> np.ndarray:
        return np.clip((error - self.lo) / max(self.hi - self.lo, 1e-9), 0, 1)

    def parts(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        z = (x - self.mean) / self.std
        rest = z - (z @ self.components) @ self.components.T
        parts = rest ** 2 / x.shape[1]
        start = float(self._score(np.zeros(1))[0])
        return start, _rescaled(parts, self._score(parts.sum(axis=1)), start)


def _boosted(model) -> BoostedTrees:
    """Node tables of a fitted booster, read from its Java trees (trees x nodes: bounded)."""
    trees = []
    for tree in model.trees:
        rows: list[list] = []

        def walk(node) -> int:
            at = len(rows)
            rows.append([-1, 0.0, -1, -1, node.prediction()])
            if node.subtreeDepth() > 0:
                split = node.split()
                rows[at][:2] = [split.featureIndex(), split.threshold()]
                rows[at][2] = walk(node.leftChild())
                rows[at][3] = walk(node.rightChild())
            return at

        walk(tree._java_obj.rootNode())
        feature, threshold, left, right, value = (np.array(c) for c in zip(*rows))
        trees.append(Tree(feature.astype(int), threshold.astype(float), left.astype(int), right.astype(int), value.astype(float)))
    return BoostedTrees(trees, [float(w) for w in model.treeWeights])


def _isolation(model: M.IsolationForestModel) -> IsolationTrees:
    trees = []
    for _, t in model.trees.sort_values(["tree", "node"]).groupby("tree"):
        feature, left, right, size = (t[c].to_numpy() for c in ("feat", "left", "right", "size"))
        depth = np.zeros(len(t))
        for i in range(len(t)):                                  # parents come before their children
            if feature[i] >= 0:
                depth[[left[i], right[i]]] = depth[i] + 1
        value = depth + M.unsuccessful_search(size)
        for i in reversed(range(len(t))):
            if feature[i] >= 0:
                value[i] = (size[left[i]] * value[left[i]] + size[right[i]] * value[right[i]]) / max(size[i], 1)
        trees.append(Tree(feature, t["split"].to_numpy(), left, right, value, equal_left=False))
    return IsolationTrees(trees, M.typical_path(model.sample_size), model.lo, model.hi)


def explainer_of(model):
    if isinstance(model, M.IsolationForestModel):
        return _isolation(model)
    if isinstance(model, M.ReconstructionModel):
        return Residuals(np.array(model.mean), np.array([s or 1.0 for s in model.std]), model.pca.pc.toArray(), model.lo, model.hi)
    return _boosted(model)


def margin_parts(df: DataFrame, ensemble: M.Ensemble, features: str = "features") -> DataFrame:
    """``df`` with ``base_margin``, ``margin`` and ``parts``, one contribution per feature."""
    parts_of = [explainer_of(ensemble.base[n]) for n in ensemble.names]
    coefs = [float(c) for c in ensemble.meta.coefficients.toArray()]
    intercept = float(ensemble.meta.intercept)

    @F.pandas_udf(PARTS_SCHEMA)
    def explained(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.vstack(batch.to_numpy()) if len(batch) else np.zeros((0, 1))
            base, total = intercept, np.zeros(x.shape)
            for one, c in zip(parts_of, coefs):
                start, parts = one.parts(x)
                base += c * start
                total += c * parts
            yield pd.DataFrame({"base_margin": base, "margin": base + total.sum(axis=1), "parts": list(total)},
                               index=range(len(x)))

    out = df.withColumn("_explained", explained(vector_to_array(F.col(features))))
    return out.select(*df.columns, "_explained.base_margin", "_explained.margin", "_explained.parts")


def reasons(names: Sequence[str], parts: str = "parts", features: str = "features", top_k: int = 5) -> Column:
    """The ``top_k`` features of the largest contributions by absolute value, ties in feature order, in-row."""
    values = vector_to_array(F.col(features))
    every = F.transform(F.col(parts), lambda c, i: F.struct(
        F.get(F.array(*[F.lit(n) for n in names]), i).alias("feature"), F.get(values, i).alias("value"), c.alias("contribution"),
        F.when(c > 0, "up fraud").otherwise("down fraud").alias("direction"), i.alias("at")))
    first = F.array_sort(every, lambda a, b: F.when(F.abs(a["contribution"]) != F.abs(b["contribution"]),
                                                    F.signum(F.abs(b["contribution"]) - F.abs(a["contribution"])).cast("int"))
                         .otherwise(a["at"] - b["at"]))
    return F.transform(F.slice(first, 1, top_k), lambda r: F.struct(r["feature"].alias("feature"), r["value"].alias("value"),
                                                                    r["contribution"].alias("contribution"), r["direction"].alias("direction")))


def feature_importance(explained: DataFrame, names: Sequence[str], top: int = 20) -> DataFrame:
    """Mean absolute contribution per feature, the ``top`` largest (one partial aggregation)."""
    stacked = explained.select(F.posexplode("parts").alias("at", "c")).groupBy("at").agg(F.avg(F.abs("c")).alias("mean_abs_contribution"))
    return stacked.select(F.get(F.array(*[F.lit(n) for n in names]), F.col("at")).alias("feature"), "mean_abs_contribution") \
        .orderBy(F.desc("mean_abs_contribution"), "feature").limit(top)
