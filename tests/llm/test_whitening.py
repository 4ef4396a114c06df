"""Whitening against exact integer statistics and eigenvectors of known spectra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def spectrum(name):
    return {"spread": np.linspace(1, 9, 40), "two values": np.r_[np.ones(20), np.full(20, 2.0)], "one value": np.full(30, 3.0),
            "close": np.r_[1 + 1e-9 * np.arange(9), np.linspace(2, 5, 20)], "closer": np.r_[1 + 1e-12 * np.arange(9), 5 + 1e-13 * np.arange(9)],
            "rank": np.r_[np.zeros(10), np.linspace(1, 2, 10)], "graded": 10.0 ** np.linspace(-8, 4, 30)}[name]


@pytest.mark.parametrize("name", ["spread", "two values", "one value", "close", "closer", "rank", "graded"])
def test_refined_eigenvectors(name):
    wanted = spectrum(name)
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(len(wanted),) * 2))
    a = (q * wanted) @ q.T
    a = (a + a.T) / 2
    values, x = whitening.refined_eigenvectors(a)
    norm = np.linalg.norm(a)
    wide = np.longdouble
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-13
    assert np.abs(a.astype(wide) @ x.astype(wide) - x.astype(wide) * values.astype(wide)).max() < 1e-14 * norm
    assert np.abs(np.sort(wanted)[::-1] - values).max() < 1e-14 * norm and (np.diff(values) <= 0).all()


def test_single_precision_alone_would_not_do():
    """The refinement gains what single precision lacks."""
    a = np.diag([1.0, 1 + 1e-8, 2.0])
    q, _ = np.linalg.qr(np.random.default_rng(0).normal(size=(3, 3)))
    a = q @ a @ q.T
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    _, x = whitening.refined_eigenvectors((a + a.T) / 2)
    off = [np.abs((m.T @ a @ m)[~np.eye(3, dtype=bool)]).max() for m in (rough, x)]
    assert off[0] > 1e-9 and off[1] < 1e-15


def rows_of(vectors):
    return [(i, None if v is None else [None if e is None else float(e) for e in v]) for i, v in enumerate(vectors)]


def test_whole_result(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(size=(300, 8)).astype(np.float32) * np.r_[3, 2, 2, 1, 1, 1, .5, .1].astype(np.float32)
    good[40:90] = good[0]                                            # copies count as often as they occur
    bad = [None, [1.0] * 7 + [None], [float("nan")] * 8, [float("inf")] + [0.0] * 7, [], [1.0, 2.0], [0.5] * 9]
    rows = rows_of([*good.tolist(), *bad]) + [(None, good[5].tolist())]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"n": F.lit("?"), "whitened": F.lit(0), "i": F.lit(7)})
    got = whitening.whiten(frame, components=5).collect()
    vectors = np.vstack([good, good[5:6]]).astype(float)
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    assert len(got) == n * 5 and {r["n"] for r in got} == {n}
    deviation = ((n * x - s) ** 2).sum(axis=1)
    assert all(r["deviation"] == deviation[n - 1 if r["vec_id"] is None else r["vec_id"]] for r in got)
    centred = x - s / n
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    for k in range(5):
        share = {r["explained"] for r in got if r["component"] == k + 1}
        assert len(share) == 1 and abs(share.pop() / (values[k] / np.trace(cov)) - 1) < 1e-9
    by_id = {r["vec_id"]: {} for r in got}
    for r in got:
        by_id[r["vec_id"]][r["component"]] = r["whitened"]
    w = np.array([[by_id[i][k] for k in range(1, 6)] for i in [*range(300), None]])
    error = np.abs(w.T @ w / n - np.eye(5)).max()
    assert error < 1e-10 and all(abs(r["identity_error"] - error) < 1e-10 for r in got)


def test_degenerate_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one, key=lambda r: r["component"])] == [
        (1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 5.0]) for i in range(10)], SCHEMA)).collect()     # one direction only
    assert {r["component"] for r in flat if r["whitened"] is not None} == {1} and flat[0]["identity_error"] < 1e-12
    # of equally common lengths the greater counts
    assert {r["vec_id"] for r in whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA)).collect()} == {2}


def test_large_entries_stay_exact(spark):
    rows = [(i, [2e6 * i, -3e6 * i + 0.3]) for i in range(4)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    x = [[int(np.floor(64 * float(np.float32(e)))) + 1_000_000 for e in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    assert got == {i: sum((4 * e - s) ** 2 for e, s in zip(v, sums)) for i, v in enumerate(x)}
