"""PCA whitening of embeddings by mixed-precision eigenvectors of the covariance.

Entries become integers, x = floor(64 * c) + 1,000,000, so sums over all rows are
exact whatever the order: Spark adds per-task sums and, in a second pass, per-task products of rows
centred by the rounded mean. Only d sums and d * d products (d: dimensions, not rows) reach the driver.

The eigenvectors of that covariance V are found in single precision and then
refined by matrix multiplications in higher precision (Ogita and Aishima's iteration, extended
precision where the platform has it). With X the current vectors, R = I - X'X and S = X'VX give
Rayleigh values l_i = S_ii / (1 - R_ii) and a correction E, X <- X + XE, with

    E_ij = (S_ij + l_j R_ij) / (l_j - l_i)   where the values are apart,
    E_ij = R_ij / 2                          where they are not (and on the diagonal).

It converges quadratically where eigenvalues are apart. Values that
are not form clusters; in each, the vectors' span is right but they are mixed.
A sub-solve turns them: the small matrix X_c'(V - mu I)X_c, formed in higher
precision with the cluster's middle mu taken off, has the cluster's spread as its norm, so its
single-precision eigenvectors resolve values that V's did not. Turning and refining alternate until
the correction is below double precision. Equal values may have any basis of their span.

Cases: rows whose vector is null, or has a null or non-finite entry, are dropped, and so are rows
whose length is not the commonest one (of equally common ones the greater; a vector without entries never counts).
Repeated vectors and ids count as often as they occur; a row without id stays. A component
without variance (rank-deficient input, one row, constant entries) has no unit scale: its ``whitened`` is null
and it is left out of ``identity_error``; without any variance ``explained`` is null as well. A squared
deviation beyond a long is null. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Precision of the refinement's products, and its most rounds (it ends by itself long before).
WIDE = np.longdouble
MOST_ROUNDS = 60
_EXACT = 1 << 53
_LONG = 1 << 63


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, integer matrix) for the usable vectors of a batch, by length."""
    lists = batch.column(column)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    starts = lists.offsets.to_numpy()
    sizes = np.diff(starts)
    usable = lists.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for size in np.unique(sizes[usable]):
        rows = np.flatnonzero(usable & (sizes == size))
        matrix = values[starts[rows][:, None] + np.arange(size)]
        fine = np.isfinite(matrix).all(axis=1)
        yield int(size), rows[fine], np.floor(SCALE * matrix[fine]).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for size, rows, x in _blocks(batch, 0):
            if len(rows):
                have = found.setdefault(size, [0, np.zeros(size, object)])
                have[0] += len(rows)
                have[1] = have[1] + x.sum(axis=0, dtype=np.int64)
    for size, (n, total) in found.items():
        yield pa.RecordBatch.from_arrays([
            pa.array([size] * size, pa.int32()), pa.array([n] * size, pa.int64()), pa.array(range(size), pa.int32()),
            pa.array(total.tolist(), pa.int64())], ["size", "n", "i", "s"])


def _product_sums(matrix_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], exact: bool):
    """A task's sum of products of all pairs of columns, as rows (i, j, value) with j >= i.

    Integer products are exact: blocks of rows are so short that a sum of doubles holds it, and the blocks are added as integers.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for y in matrix_of(batch):
                if not len(y):
                    continue
                top = max(1, int(np.abs(y).max())) ** 2 if exact else 1
                rows = max(1, min(4096, _EXACT // top)) if exact else 4096
                for at in range(0, len(y), rows):
                    block = y[at:at + rows]
                    if exact and top >= _EXACT:
                        one = block.astype(object)
                        product = one.T @ one
                    else:
                        product = block.astype(np.float64).T @ block.astype(np.float64)
                        product = product.astype(np.int64).astype(object) if exact else product
                    total = product if total is None else total + product
        if total is not None:
            i, j = np.triu_indices(len(total))
            cells = total[i, j].tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                pa.array([str(v) for v in cells], pa.string()) if exact else pa.array(cells, pa.float64())], ["i", "j", "v"])
    return work


@dataclass
class Moments:
    """Exact moments of the fit list: rows, sums, and n * n * V as integers."""
    n: int
    sums: list[int]
    scaled: list[list[int]]

    def covariance(self) -> np.ndarray:
        """V, rounded only to the wide type."""
        square = self.n * self.n

        def wide(v: int) -> np.longdouble:
            exact = Fraction(v, square)
            return WIDE(float(exact)) + WIDE(float(exact - Fraction(float(exact))))
        return np.array([[wide(v) for v in row] for row in self.scaled], WIDE)


def moments(vectors: DataFrame) -> Moments | None:
    """Of a frame (vec_id, embedding); None without a usable row."""
    counted = vectors.select("embedding").mapInArrow(_sums, "size int, n bigint, i int, s bigint") \
        .groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    if not counted:
        return None
    size = max((r["n"], r["size"]) for r in counted)[1]
    mine = sorted((r for r in counted if r["size"] == size), key=lambda r: r["i"])
    n, sums = mine[0]["n"], [int(r["s"]) for r in mine]
    near = np.array([round(Fraction(s, n)) for s in sums], np.int64)

    def centred(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        return (x - near for d, _, x in _blocks(batch, 0) if d == size)

    cells = vectors.select("embedding").mapInArrow(_product_sums(centred, True), "i int, j int, v string") \
        .groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    rest = [s - n * int(k) for s, k in zip(sums, near)]
    scaled = [[0] * size for _ in range(size)]
    for r in cells:
        scaled[r["i"]][r["j"]] = scaled[r["j"]][r["i"]] = n * int(r["v"]) - rest[r["i"]] * rest[r["j"]]
    return Moments(n, sums, scaled)


def _eigh32(a: np.ndarray) -> np.ndarray:
    """Eigenvectors in single precision, of a scaled copy that single precision can hold."""
    top = float(np.abs(a).max())
    if top == 0:
        return np.eye(len(a), dtype=WIDE)
    return np.linalg.eigh((a / top).astype(np.float32))[1].astype(WIDE)


def _rotation(a: np.ndarray) -> np.ndarray:
    """Single-precision eigenvectors, made orthogonal in higher precision."""
    w = _eigh32(a)
    for _ in range(2):
        w = w @ (3 * np.eye(len(w), dtype=WIDE) - w.T @ w) / 2
    return w


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Groups of two and more indices whose values follow each other within ``gap``."""
    order = np.argsort(values)
    cut = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, cut) if len(c) > 1]


def refined_eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, to double precision."""
    a = v.astype(WIDE)
    d = len(a)
    one, scale = np.eye(d, dtype=WIDE), float(np.linalg.norm(a.astype(np.float64)))
    least = 4 * d * scale * float(np.finfo(WIDE).eps)
    x, before = _eigh32(a), np.inf
    for _ in range(MOST_ROUNDS):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = s + values[None, :] * r
        np.fill_diagonal(off, 0)
        # values closer than what the off-diagonal part may move them count as one
        gap = max(least, 2 * (float(np.linalg.norm(off.astype(np.float64))) + scale * float(np.linalg.norm(r.astype(np.float64)))))
        apart = values[None, :] - values[:, None]
        far = np.abs(apart) > gap
        e = np.where(far, off / np.where(far, apart, 1), r / 2)
        x = x + x @ e
        turned = False
        for c in _clusters(values, gap):
            middle = (values[c].max() + values[c].min()) / 2
            part = x[:, c].T @ (a @ x[:, c]) - middle * (x[:, c].T @ x[:, c])
            part = (part + part.T) / 2
            if float(np.abs(part - np.diag(np.diag(part))).max()) > least:
                x[:, c] = x[:, c] @ _rotation(part)
                turned = True
        size = float(np.abs(e).max())
        # a correction leaves an error of its square: this one was the last that doubles can see
        if not turned and (size < 1e-12 or before / 4 < size < 1e-6):
            break
        before = np.inf if turned else size
    x = x @ (3 * one - x.T @ x) / 2
    values = np.diag(x.T @ (a @ x)) / np.diag(x.T @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    return values[order].astype(np.float64), x.astype(np.float64)


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray      # eigenvalues, falling
    vectors: np.ndarray     # eigenvectors as columns
    explained: list[float | None]
    scaled: np.ndarray      # vectors over the root of their values; a column of NaN without variance


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    m = moments(vectors)
    if m is None:
        return None
    v = m.covariance()
    values, x = refined_eigenvectors(v)
    values, x = values[:components], x[:, :components]
    trace = float(np.trace(v))
    alive = values > len(v) * np.finfo(np.float64).eps * max(float(values[0]), 0.0)
    scaled = np.where(alive, x / np.sqrt(np.where(alive, values, 1)), np.nan)
    return Whitening(m.n, m.sums, values, x, [float(e) / trace if trace > 0 else None for e in values], scaled)


def _whitener(model: Whitening):
    """Usable rows -> (vec_id, deviation, whitened array)."""
    n, size, count = model.n, len(model.sums), len(model.values)
    mean = [divmod(s, n) for s in model.sums]
    whole = np.array([q for q, _ in mean], np.int64)
    part = np.array([r / n for _, r in mean])
    rest = [r for _, r in mean]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in _blocks(batch, 1):
                if d != size or not len(rows):
                    continue
                y = x - whole                       # n * x - S = n * y - rest
                top = n * (int(np.abs(y).max()) + 1)
                if size * top * top < _LONG:
                    far = n * y - np.array(rest, np.int64)
                    deviation = (far * far).sum(axis=1).tolist()
                else:
                    far = [sum((n * int(a) - b) ** 2 for a, b in zip(row, rest)) for row in y]
                    deviation = [v if v < _LONG else None for v in far]
                white = (y - part) @ model.scaled
                flat = pa.array(white.ravel(), mask=np.isnan(white).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * count, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(deviation, pa.int64()), lists], ["vec_id", "deviation", "whitened"])
    return work


def identity_error(white: DataFrame, n: int, alive: list[int]) -> float | None:
    """Largest entry of the covariance of the components ``alive`` minus the identity, measured on the whitened rows."""
    if not alive:
        return None
    means = white.select(F.posexplode("whitened").alias("i", "v")).groupBy("i").agg((F.sum("v") / n).alias("m")).collect()
    mean = {r["i"]: r["m"] for r in means}
    centre = np.array([mean[i] for i in alive])

    def centred(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        lists = batch.column(0)
        yield lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)[:, alive] - centre

    cells = white.select("whitened").mapInArrow(_product_sums(centred, False), "i int, j int, v double") \
        .groupBy("i", "j").agg((F.sum("v") / n).alias("v")).collect()
    return max(abs(r["v"] - (r["i"] == r["j"])) for r in cells)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: deviation, whitened coordinate, explained share, and the measured identity error."""
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = fit_whitening(vectors, components)
    if model is None:
        return spark.createDataFrame([], schema)
    white = scratch(vectors.mapInArrow(_whitener(model), "vec_id bigint, deviation bigint, whitened array<double>"), "whitened")
    error = identity_error(white, model.n, np.flatnonzero(~np.isnan(model.scaled).any(axis=0)).tolist())
    explained = F.array(*[F.lit(e).cast("double") for e in model.explained])
    return white.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
