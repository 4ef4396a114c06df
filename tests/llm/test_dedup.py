import hashlib

import numpy as np
import pytest
import xxhash
import re

from riskweave.llm import exact_dedup as X
from riskweave.llm import simhash_dedup as N

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = [(0, "A b C"), (1, "a B c"), (2, None), (3, ""), (4, "É"), (5, "é"), (6, "a b c "), (7, "x" * 50000), (8, "X" * 50000),
        (9, "a b c")] + [(100 + i, "copy of One") for i in range(60)] + [(200 + i, f"only {i}") for i in range(80)]


def test_exact_duplicates_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in DOCS], "doc_id long, text string, keep_id string, n int")
    groups = {}
    for i, t in DOCS:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    got = {r["doc_id"]: r for r in X.exact_duplicates(df, buckets=3).collect()}
    assert len(got) == len(DOCS)
    for text, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_exact_duplicates_without_ids_or_rows(spark):
    assert X.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a"), (None, "A"), (None, "b"), (5, "b"), (5, "b")], "doc_id long, text string")
    got = sorted(X.exact_duplicates(df).select("doc_id", "keep_id", "group_size", "kept").collect(), key=str)
    assert [tuple(r) for r in got] == [(5, 5, 3, True), (5, 5, 3, True), (None, 5, 3, False), (None, None, 2, True), (None, None, 2, True)]


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_minimal_perfect_hash(n):
    rng = np.random.default_rng(n)
    d = rng.integers(0, 256, (n, 32), dtype=np.uint8)
    sizes, bits, slot = X.build_mph(d)
    assert sorted(slot) == list(range(n))                                # minimal and perfect
    assert (X.find_slots(d, sizes, bits) == slot).all()
    assert sum(sizes) <= 8 * n + 80
    other = rng.integers(0, 256, (n, 32), dtype=np.uint8)
    found = X.find_slots(other, sizes, bits)
    held = np.empty_like(d)
    held[slot] = d
    assert not (held[found[found >= 0]] == other[found >= 0]).all(axis=1).any()   # bytes tell strangers apart


def test_index_lookup_tells_members_from_strangers(spark):
    old = X.digests(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string"))
    new = X.digests(spark.createDataFrame([(9, "A"), (10, "c"), (11, "c")], "doc_id long, text string"))
    totals = X.lookup(X.build_index(old, 2), new, 2).collect()
    h = {hashlib.sha256(t.encode()).digest(): t for t in "abc"}
    assert {h[bytes(r["digest"])]: (r["keep_id"], r["group_size"], r["member"]) for r in totals} == {
        "a": (9, 3, True), "b": (2, 1, True), "c": (11, 2, False)}


def brute_fingerprint(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    s = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def near_corpus():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(500)]
    docs = []
    for g in range(12):
        words = list(rng.choice(vocab, 120))
        for c in range(6 if g else 40):
            w = words.copy()
            if c:
                w[int(rng.integers(0, 120))] = "edit" + str(c)
            docs.append(" ".join(w))
    docs += [None, "", " \t\n", "One", "one", "two words", "ea " * 3000, "Ea " * 2990, "\x0bpad pad\x0c pad  pad\r"]
    return list(enumerate(docs))


def components(fps, radius):
    ids = sorted(fps)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if label[j] < label[i] and bin(fps[i] ^ fps[j]).count("1") <= radius:
                    label[i], changed = label[j], True
    return label


def test_near_duplicates_match_brute_force(spark):
    docs = near_corpus()
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, fp string")
    got = {r["doc_id"]: r for r in N.near_duplicates(df).collect()}
    fps = {i: brute_fingerprint(t) for i, t in docs}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{v:016x}" for i, v in fps.items()}
    assert {i: r["component_id"] for i, r in got.items()} == components(fps, 4)


def test_manhattan_distance_bounds_hamming(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(1)
    pairs = [tuple(int(x) for x in rng.integers(-2**63, 2**63 - 1, 2)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a long, b long").select(
        "a", "b", F.bit_count(N._thermometer(F.col("a")).bitwiseXOR(N._thermometer(F.col("b")))).alias("m"))
    for r in df.collect():
        a, b = r["a"] % 2**64, r["b"] % 2**64
        counts = [abs(bin(a >> 2 * s & 3).count("1") - bin(b >> 2 * s & 3).count("1")) for s in range(32)]
        assert r["m"] == sum(counts) <= bin(a ^ b).count("1")


@pytest.mark.parametrize("radius", [0, 2, 4, 6])
def test_groups_of_dense_clusters(spark, radius):
    rng = np.random.default_rng(radius)
    fps = set()
    for c in rng.integers(0, 2**63 - 1, 12):
        for _ in range(40):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.add(x - 2**64 if x >= 2**63 else x)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r["node"]: r["label"] for r in N.group_fingerprints(df, radius).collect()}
    want = components({x: x % 2**64 for x in fps}, radius)
    assert {x: got.get(x, x) for x in fps} == want


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, "q")], "doc_id long, text string")
    assert sorted(str(r["component_id"]) for r in N.near_duplicates(df).collect()) == ["7", "7", "7", "None"]
