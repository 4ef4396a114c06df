import hashlib

import numpy as np
import pytest

from riskweave.llm import fingerprints as P


def rows(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, fp string")


def test_edited_text_follows_descending_ids(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 7)         # many ranges: the seams must not show
    rng = np.random.default_rng(4)
    ids = [int(x) for x in rng.choice(1000, 60, replace=False)]
    docs = [(i, None if i % 9 == 0 else "é😀ab "[: i % 6] * (i % 40), "x") for i in ids]
    got = {r["doc_id"]: r for r in P.fingerprint_documents(rows(spark, docs)).collect()}
    text = {i: t or "" for i, t, _ in docs}
    order = sorted(text, reverse=True)
    for n, i in enumerate(order):
        t, nxt = text[i], text[order[(n + 1) % len(order)]]
        k = len(t) // 3
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256((t[:len(t) - k] + nxt[:k]).encode()).hexdigest()
        a, b = (int(got[x]["fingerprint"], 16) for x in (i, order[(n + 1) % len(order)]))
        assert got[i]["near_next"] == pytest.approx(1 - bin(a ^ b).count("1") / 64)


def test_search_finds_all_within_the_radius(spark):
    rng = np.random.default_rng(9)
    fps = set()
    for c in rng.integers(0, 2**62, 20):
        for _ in range(15):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            fps.add(x - 2**64 if x >= 2**63 else x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    asked = spark.createDataFrame([(x,) for x in fps[::4]], "fp long")
    got = sorted((r["a"], r["b"]) for r in P.find_within(asked, df, 3).collect())
    assert got == sorted((a, b) for a in fps[::4] for b in fps if a != b and bin((a ^ b) % 2**64).count("1") <= 3)


def test_likeness_tells_edits_from_strangers(spark):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 4000, 150)), "") for i in range(40)]
    got = P.fingerprint_documents(rows(spark, docs)).collect()
    assert min(r["near_edited"] for r in got) > max(r["near_next"] for r in got) - 0.05
    assert np.mean([r["near_edited"] for r in got]) > np.mean([r["near_next"] for r in got]) + 0.15


def test_edge_cases(spark):
    assert P.fingerprint_documents(rows(spark, [])).count() == 0
    one = P.fingerprint_documents(rows(spark, [(5, "abc def ghi", "")])).first()
    assert one["near_next"] == 1.0 and one["n_within"] is None
    none = P.fingerprint_documents(rows(spark, [(None, "b", ""), (None, None, ""), (20, "b", ""), (20, "b", "")])).collect()
    assert len(none) == 4 and {r["n_within"] for r in none if r["doc_id"] == 20} == {2}
    assert {r["fingerprint"] for r in none if r["n_chars"] == 0} == {"0" * 16}
    only_null = P.fingerprint_documents(rows(spark, [(None, "b", ""), (None, "a", "")])).collect()
    assert sorted(r["n_chars"] for r in only_null) == [1, 1]
    long = P.fingerprint_documents(rows(spark, [(1, "word " * 60000, ""), (2, "other", "")])).collect()
    assert len(long) == 2


def test_main_path_has_no_python(spark):
    plan = P.fingerprint_documents(rows(spark, [(1, "a b", "")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
