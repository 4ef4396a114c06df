"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: byte n-grams of the text, and n-grams
of token shapes (letters, digits and marks, with a sign for a token that
repeats the one before it). Each indicator is scaled by the log ratio of its
class counts; a linear hinge-loss model on the scaled, length-normalised
indicators is fitted by dual coordinate descent. Several tasks fit one share of a
bounded sample each and the weights are averaged; a logistic curve fitted on a share that no
task has seen turns margins into scores (a class with very few labels serves several of these steps).
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, text_or_empty
from .labelled import PARTS, labelled_sample

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 12_000
THRESHOLD = 0.3
WIDTH = 1 << 18
BYTE_ORDERS = (2, 3, 4)
SHAPE_ORDERS = (1, 2, 3)
SMOOTHING = 1.0
PENALTY, PASSES = 1.0, 12
REMEMBERED = 400_000


@dataclass
class NbSvm:
    ratio: np.ndarray  # log count ratio per hashed n-gram
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    constant: float | None = None


class NGrams:
    """Distinct hashed n-grams of a text."""

    def __init__(self):
        self.place = np.zeros(WIDTH, np.int64)
        self.known: dict[str, int] = {}
        self.runs = re.compile(r"(a+|0+|(.)\2+)", re.S)

    def _token(self, t: str) -> int:
        """Hash of the token's shape (low 24 bits) and of the token (above)."""
        shape = "".join("a" if c.isalpha() else "0" if c.isdigit() else c for c in t)
        shape = self.runs.sub(lambda m: m.group(0)[:1] + ("+" if len(m.group(0)) > 1 else ""), shape)
        return (zlib.crc32(shape.encode("utf-8", "replace")) & 0xFFFFFF) | (zlib.crc32(t.encode("utf-8", "replace")) << 24)

    @staticmethod
    def _hashes(parts: list[np.ndarray], salt: int) -> np.ndarray:
        n = min(len(p) for p in parts)
        h = np.full(n, salt * 2654435761, np.uint64)
        for p in parts:
            h ^= p[:n]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h & np.uint64(WIDTH - 1)).astype(np.int64)

    def __call__(self, text: str) -> np.ndarray:
        b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint64)
        found = [np.zeros(0, np.int64)]
        with np.errstate(over="ignore"):
            found += [self._hashes([b[i:] for i in range(k)], k) for k in BYTE_ORDERS if len(b) >= k]
            tokens = text.split()
            if tokens:
                known = self.known
                if len(known) > REMEMBERED:
                    known.clear()
                v = [*map(known.get, tokens)]
                if None in v:
                    for i, x in enumerate(v):
                        if x is None:
                            v[i] = known[tokens[i]] = self._token(tokens[i])
                v = np.array(v, np.uint64)
                s = (v & np.uint64(0xFFFFFF)) * np.uint64(2)
                s[1:] += v[1:] == v[:-1]
                found += [self._hashes([s[i:] for i in range(k)], 100 + k) for k in SHAPE_ORDERS if len(s) >= k]
        # keeps the last occurrence of each hash, without sorting
        h = np.concatenate(found)
        at = np.arange(len(h))
        self.place[h] = at
        return h[self.place[h] == at]


def count_classes(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts of each class (y 1, y 0) that show each hashed n-gram; one vector per task reaches the driver."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, totals = NGrams(), np.zeros((2, WIDTH), np.float32)
        for b in batches:
            for text, y in zip(b["text"], b["y"]):
                totals[int(y), grams(text)] += 1
        yield pd.DataFrame({"totals": [totals.tobytes()]})

    total = np.zeros((2, WIDTH))
    for r in sample.select("text", "y").coalesce(8).mapInPandas(count, "totals binary").toLocalIterator():
        total += np.frombuffer(r["totals"], np.float32).reshape(2, WIDTH)
    return total[1], total[0]


def log_count_ratio(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    p, q = good + SMOOTHING, bad + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def scaled(found: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Values of a text's indicators: class ratios, normalised to length 1."""
    v = ratio[found]
    norm = float(np.sqrt(v @ v))
    return v / norm if norm else v


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray,
                            passes: int = PASSES, seed: int = 11) -> tuple[np.ndarray, float]:
    """Hinge loss, weight 1/2 |w|^2: one dual variable per row, updated in random order, kept in [0, cost].

    The bias is one more feature of value 1.
    """
    w, bias, alpha = np.zeros(WIDTH), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            idx, v = rows[i]
            g = y[i] * (float(w[idx] @ v) + bias) - 1.0
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[idx] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def fit_shares(sample: DataFrame, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Average of the models fitted on each learning part of the sample; a row of several parts is in each of their models."""
    def fit_part(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = NGrams()
        rows = []
        for text in pdf["text"]:
            found = grams(text)
            rows.append((found, scaled(found, ratio)))
        y = np.where(pdf["y"].to_numpy() > 0, 1.0, -1.0)
        # classes weigh the same in the loss whatever their shares
        share = {c: max(float((y == c).mean()), 1e-9) for c in (1.0, -1.0)}
        cost = np.array([PENALTY * 0.5 / share[c] for c in y])
        w, bias = dual_coordinate_descent(rows, y, cost)
        return pd.DataFrame({"w": [w.astype(np.float32).tobytes()], "bias": [bias]})

    dealt = sample.select(F.explode("parts").alias("part"), "text", "y").where(F.col("part") < PARTS - 1)
    fitted = dealt.groupBy("part").applyInPandas(fit_part, "w binary, bias double").collect()
    w = sum(np.frombuffer(r["w"], np.float32).astype(np.float64) for r in fitted) / len(fitted)
    return w, sum(r["bias"] for r in fitted) / len(fitted)


def logistic_curve(margin: np.ndarray, y: np.ndarray, steps: int = 50, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of P(y=1) = 1 / (1 + exp(-(slope m + offset))) by Newton steps, lightly damped."""
    weight = np.ones(len(margin)) if weight is None else weight
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((len(y) - y.sum()) + 2))
    b = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (target - p)))
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def marginer(ratio: np.ndarray, weights: np.ndarray, bias: float):
    """Column function: text column -> margin."""
    value = (weights * ratio).astype(np.float32)
    square = (ratio * ratio).astype(np.float32)

    @F.pandas_udf("double")
    def margin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams = NGrams()
        for batch in batches:
            out = np.full(len(batch), bias)
            for i, text in enumerate(batch):
                found = grams(text)
                norm = float(square[found].sum()) ** 0.5
                if norm:
                    out[i] += float(value[found].sum(dtype=np.float64)) / norm
            yield pd.Series(out)

    return lambda col: margin(text_or_empty(col))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held: int = 0,
        rows: int = SAMPLE_ROWS) -> NbSvm:
    """Fit on about ``rows`` labelled documents outside the held-out fold (a documented bound, see ``labelled_sample``)."""
    sample = labelled_sample(docs, labels, label, modulus, held, rows)
    zero = np.zeros(WIDTH)
    if not sample.both:
        return NbSvm(zero, zero, 0.0, 0.0, 0.0, sample.base)
    train = sample.part(*range(PARTS - 1))
    ratio = log_count_ratio(*count_classes(train))
    weights, bias = fit_shares(train, ratio)
    judged = sample.part(PARTS - 1).select("y", "w", marginer(ratio, weights, bias)("text").alias("m")).collect()
    slope, offset = logistic_curve(np.array([r["m"] for r in judged]), np.array([float(r["y"]) for r in judged]),
                                   weight=np.array([r["w"] for r in judged]))
    return NbSvm(ratio, weights, bias, slope, offset)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: NbSvm | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null text counts as empty: no n-grams, the margin is the bias. Null ids give
    a null held_out. Without labels of both classes the score is their constant share (0 without any).
    """
    m = model or fit(docs, labels)
    held = (fold("doc_id", 5) == 0).alias("held_out")
    if m.constant is not None:
        scored = docs.select("doc_id", held, F.lit(m.constant).alias("score"))
    else:
        margin = docs.select("doc_id", held, marginer(m.ratio, m.weights, m.bias)("text").alias("m"))
        scored = margin.select("doc_id", "held_out", (1 / (1 + F.exp(-(F.col("m") * m.slope + m.offset)))).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
