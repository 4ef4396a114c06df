import re

import pytest

import corpus_pipeline as C
from pyspark.sql import functions as F
from riskweave.llm import exact_dedup, simhash_dedup
from riskweave.llm.common import scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in C.STAGES:
        out.append(scratch(f(spark, out[-1], SF), f"test-{name}"))
    return out


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda i: (i is None, i))


def test_stages_keep_the_columns_and_only_narrow(staged):
    docs, *rest = staged
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing"]
    for a, b in zip(staged, rest[:-1]):
        assert b.columns == docs.columns and set(ids(b)) <= set(ids(a))


def test_language_stage_rejects_only_texts_without_letters(staged):
    docs, kept = staged[0], staged[1]
    want = sorted(r["doc_id"] for r in docs.collect() if r["text"] and re.search(r"[^\W\d_]", r["text"]))
    assert ids(kept) == want


def test_dedup_stages_match_brute_force(staged):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last = {}
    for r in staged[1].collect():
        key = (r["text"] or "").translate(lower)
        last[key] = max(last.get(key, r["doc_id"]), r["doc_id"])
    assert ids(staged[2]) == sorted(last.values())
    groups = simhash_dedup.near_duplicates(staged[2]).collect()
    assert ids(staged[3]) == sorted({r["component_id"] for r in groups})
    assert exact_dedup.exact_duplicates(staged[2]).where("NOT kept").count() == 0


def test_secrets_are_masked_and_clean_texts_unchanged(staged):
    before = {r["doc_id"]: r for r in staged[3].collect()}
    secret = re.compile(r"[0-9a-f]{32,}|AKIA[A-Z0-9]{12,}")
    masked = 0
    for r in staged[4].collect():
        if r["text"] == before[r["doc_id"]]["text"]:
            assert r["n_chars"] == before[r["doc_id"]]["n_chars"]
        else:
            masked += 1
            assert "[SECRET]" in r["text"] and r["n_chars"] == len(r["text"])
        assert not secret.search(r["text"])
    assert ids(staged[4]) == ids(staged[3]) and masked == sum(1 for r in before.values() if secret.search(r["text"]))


def test_packing_holds_every_document_once(staged):
    docs = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) + 1 for r in staged[4].collect()}
    got = {}
    for b in staged[5].collect():
        for d, n in zip(b["doc_ids"], b["piece_lengths"]):
            got[d] = got.get(d, 0) + n
    assert got == docs


def test_run_equals_the_stages(spark, staged):
    run = C.run(spark, SF)
    assert run.columns == staged[5].columns
    assert sorted(x for r in run.collect() for x in r["doc_ids"]) == sorted(x for r in staged[5].collect() for x in r["doc_ids"])


def test_stages_take_empty_null_repeated_and_extra(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    for _, f in C.STAGES:
        assert f(spark, empty, SF).count() == 0
    odd = spark.createDataFrame(
        [(1, "same text here", "en", "s", 14, "x")] * 3 + [(None, "same text here", "en", None, None, None),
         (2, None, None, None, None, None), (3, "", "en", "s", 0, "y"), (4, "other words password=abcdefgh12", None, "s", 31, "z")],
        "doc_id long, text string, lang string, source string, n_chars long, fp string")
    assert ids(C.exact(spark, odd, SF)) == [1, 3, 4]
    assert ids(C.near(spark, odd, SF)) == [1, 2, 4]
    nameless = spark.createDataFrame([(None, "q r s t u"), (None, "q r s t u"), (None, "v w x y z a b")], "doc_id long, text string")
    assert ids(C.exact(spark, nameless, SF)) == ids(C.near(spark, nameless, SF)) == [None, None]
    assert sorted(str(r["text"]) for r in C.secret_scan(spark, odd, SF).collect())[-1] == "same text here"
    for _, f in C.STAGES:
        f(spark, odd, SF).collect()


def test_one_row_of_each_group_stays_whatever_its_ids(spark):
    schema = "doc_id long, text string"
    odd = spark.createDataFrame([(7, "Alpha beta"), (7, "alpha beta"), (None, "ALPHA BETA"), (None, "gamma"), (None, "GAMMA"), (3, "delta"), (2, "Delta")], schema)
    got = sorted((r["doc_id"] or 0, r["text"].lower()) for r in C.exact(spark, odd, SF).collect())
    assert got == [(0, "gamma"), (3, "delta"), (7, "alpha beta")]
    near = sorted((r["doc_id"] or 0, r["text"].lower()) for r in C.near(spark, odd, SF).collect())
    assert near == [(0, "gamma"), (2, "delta"), (7, "alpha beta")]


def test_columns_with_the_names_used_inside(spark):
    inner = ["_key", "_sha", "_p", "_base", "_weak", "_lower", "_n", "_linked", "row_sha", "found", "spans", "base", "fp", "n", "h", "code", "digest",
             "gone_id", "again_sha", "Component_ID", "bucket", "column 1"]
    rows = [(i, t) for i, t in enumerate(["one two three four five", "One two three four five", None, "x password=abcdefgh12 y", "deux mots"])]
    docs = spark.createDataFrame([(i, t, "fr" if i == 4 else "en") for i, t in rows], "doc_id long, text string, lang string")
    wide = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in inner])
    for name, f in C.STAGES[:-1]:
        a, b = f(spark, docs, SF).collect(), f(spark, wide, SF)
        assert b.columns == wide.columns, name
        b = b.collect()
        assert sorted((r["doc_id"], str(r["text"])) for r in a) == sorted((r["doc_id"], str(r["text"])) for r in b), name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in b for c in inner), name
    C.pack(spark, wide, SF).collect()
