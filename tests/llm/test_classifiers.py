import itertools
import random
import zlib

import numpy as np
import pytest

from riskweave.llm import langid as L
from riskweave.llm import quality as Q
from riskweave.llm import toxicity as X

SF = "/root/testdata/sf0.01"


def auc(score, y):
    s, y = np.asarray(score), np.asarray(y)
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean())


def held(i, m, r):
    return zlib.crc32(str(i).encode()) % m == r


# ---------------------------------------------------------------- language

def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    k, lens = 3, [1, 4, 5]
    scores, mask = rng.normal(size=(3, 5, k)), np.array([[j < n for j in range(5)] for n in lens])
    moves, start = rng.normal(size=(k, k)), rng.normal(size=k)
    post, expected = L.forward_backward(scores, mask, moves, start, pairs=True)
    total = np.zeros((k, k))
    for r, n in enumerate(lens):
        paths = list(itertools.product(range(k), repeat=n))
        w = np.array([np.exp(start[p[0]] + sum(scores[r, i, p[i]] for i in range(n)) + sum(moves[a, b] for a, b in zip(p, p[1:])))
                      for p in paths])
        w /= w.sum()
        for i in range(n):
            want = [sum(x for x, p in zip(w, paths) if p[i] == c) for c in range(k)]
            assert post[r, i] == pytest.approx(want)
        for x, p in zip(w, paths):
            for a, b in zip(p, p[1:]):
                total[a, b] += x
    assert expected == pytest.approx(total)


def words_of(lang, n, rng):
    ends = {"aa": ["ing", "tion", "ed"], "bb": ["ung", "lich", "keit"], "cc": ["mente", "ado", "ez"]}[lang]
    return ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) + rng.choice(ends)
            for _ in range(n)]


def test_crf_learns_affixes_and_follows_switches():
    rng = random.Random(3)
    train = [(words_of(g, 20, rng), g) for g in ("aa", "bb", "cc") for _ in range(60)]
    model = L.train_crf([w for w, _ in train], [g for _, g in train], epochs=25)
    mixed = words_of("aa", 30, rng) + words_of("cc", 30, rng)
    share = L.Tagger(model).score([" ".join(mixed)])[0]
    assert share == pytest.approx([0.5, 0.0, 0.5], abs=0.1)
    assert (np.diag(model.moves) > model.moves.mean(axis=1)).all()          # staying is likelier than switching
    long = " ".join(words_of("bb", 5000, rng))
    assert L.Tagger(model).label([long, None, "", "123 !"])["lang_pred"].tolist() == ["bb", "und", "und", "und"]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    out = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_edge_cases(spark):
    schema = "doc_id long, text string, lang string, score double"
    assert L.identify(spark.createDataFrame([], schema)).count() == 0
    unlabelled = spark.createDataFrame([(1, "some words", None, 0.5), (None, None, "en", 0.1)], schema)
    assert {r["lang_pred"] for r in L.identify(unlabelled).collect()} == {"und"}
    train = [(i, " ".join(words_of("aa" if i % 2 else "bb", 12, random.Random(i))), "aa" if i % 2 else "bb", 0.0) for i in range(200)]
    more = [(500, None, "aa", 0.0), (501, "", "bb", 0.0), (None, "bading fotion", None, 0.0), (501, "", "bb", 0.0)]
    got = L.identify(spark.createDataFrame(train + more, schema)).collect()
    assert len(got) == 204 and {r["lang_pred"] for r in got if r["doc_id"] in (500, 501)} == {"und"}


# ---------------------------------------------------------------- toxicity

def test_toxicity_measures():
    m = X.Measure({"w:grumble": 2.0, "s:snark": 3.0})
    v = dict(zip(X.FEATURES, m("YOU are a total idiot, grumble! snarkiness sooo 1d1ot b4d")))
    assert v["fixed_hits"] > 0 and v["word_max"] == 2.0 and v["stem_max"] == 3.0 and v["near_second_person"] > 0
    assert v["capitals"] == pytest.approx(3 / 57, rel=0.1) and v["stretched"] > 0 and v["hidden"] > 0 and v["exclamations"] > 0
    assert len(m("")) == len(X.FEATURES) and all(np.isfinite(m("")))


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = X.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    y = [r["toxic"] for r in rows]
    assert auc([r["score"] for r in rows], y) > 0.93
    assert np.mean([r["predicted"] for r in rows if r["toxic"] == 0]) < 0.02
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot", 9.9), (None, None, 1.0), (3, "", 0.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert sorted(r["score"] for r in X.score_toxicity(docs, none).collect()) == [0.0, 0.0, 0.0]
    ones = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")
    many = spark.createDataFrame([(i, "text") for i in range(50)], "doc_id long, text string")
    assert {r["score"] for r in X.score_toxicity(many, ones).collect()} == {1.0}
    assert X.score_toxicity(docs.limit(0), none).count() == 0


# ---------------------------------------------------------------- quality

def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(4)
    n, d = 60, 8
    x = rng.normal(size=(n, d))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=n) > 0, 1.0, -1.0)
    rows = [(np.arange(d), v) for v in x]
    cost = np.full(n, 0.7)
    w, b = Q.dual_coordinate_descent(rows, y, cost, passes=400)
    w = w[:d]

    def primal(w, b):
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - y * (x @ w + b))).sum()
    best = primal(w, b)
    for _ in range(300):      # convex: no small step in any direction is better
        step = rng.normal(size=d + 1) * 1e-2
        assert primal(w + step[:d], b + step[d]) > best - 1e-4


def test_ngram_indicators():
    g = Q.NGrams()
    a, b = g("one two two"), g("one two two")
    assert sorted(a) == sorted(b) and len(set(a)) == len(a)
    assert len(g("")) == 0 and len(g("x")) >= 1
    assert set(g("aa aa")) != set(g("aa ab"))
    ratio = Q.log_count_ratio(np.array([8.0, 1.0]), np.array([1.0, 8.0]))
    assert ratio[0] > 0 > ratio[1] and ratio[0] == pytest.approx(-ratio[1])


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = Q.score_quality(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert auc([r["score"] for r in out], [r["quality"] for r in out]) > 0.97
    assert np.mean([r["predicted"] for r in out if r["quality"] == 1]) > 0.97


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "text", 7), (None, None, 7), (2, "x" * 100000, 7)], "doc_id long, text string, predicted int")
    got = Q.score_quality(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert [r["score"] for r in got] == [0.0] * 3 and Q.score_quality(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


# ---------------------------------------------------------------- rare classes

def rare_positives(spark, n, positives):
    """Documents with the given ids marked toxic and good, labels in both columns."""
    rng = random.Random(5)
    text = lambda i: " ".join(words_of("bb" if i in positives else "aa", 30, rng)) + (" you stupid idiot!" if i in positives else "")
    docs = spark.createDataFrame([(i, text(i)) for i in range(n)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i in positives), int(i in positives)) for i in range(n)], "doc_id long, toxic int, quality int")


@pytest.mark.parametrize("count", [3, 12])
def test_few_positives_are_learned(spark, count):
    free = [i for i in range(400) if not held(i, 4, 2) and not held(i, 5, 0)][:count]
    out = [i for i in range(400) if held(i, 4, 2) and held(i, 5, 0)][:5]
    docs, labels = rare_positives(spark, 400, {*free, *out})
    for rows in (X.score_toxicity(docs, labels).collect(), Q.score_quality(docs, labels).collect()):
        score = {r["doc_id"]: r["score"] for r in rows}
        others = [s for i, s in score.items() if i not in {*free, *out}]
        assert len({*score.values()}) > 1 and min(score[i] for i in out) > max(others)


def test_sample_keeps_rare_classes_and_their_weight(spark):
    docs, labels = rare_positives(spark, 6000, {*range(0, 6000, 300)})
    from riskweave.llm.labelled import labelled_sample
    s = labelled_sample(docs, labels.where("doc_id < 5400").union(spark.range(9000, 9500).selectExpr("id", "1", "1")), "toxic", 4, 2, 500)
    want = [i for i in range(0, 5400, 300) if not held(i, 4, 2)]
    rows = s.rows.select("y", "w", "parts").collect()
    assert sum(r["y"] for r in rows) == len(want) and len(rows) < 600
    usable = [i for i in range(5400) if not held(i, 4, 2)]
    assert s.base == pytest.approx(len(want) / len(usable))
    assert sum(r["w"] * r["y"] for r in rows) / sum(r["w"] for r in rows) == pytest.approx(s.base)
    for part in range(5):
        assert {r["y"] for r in s.part(part).collect()} == {0, 1}


def test_shape_of_a_long_token_is_read_to_its_end():
    shape = lambda t: Q.NGrams()._token(t) & 0xFFFFFF
    assert shape("x" * 64 + "=;1") != shape("x" * 64 + "yyy") and shape("x" * 64 + "yyy") == shape("xx")


def test_seventy_languages_are_all_learned(spark):
    names = [f"l{i:02d}" for i in range(70)]
    words = {n: [f"{chr(97 + i // 10)}{chr(97 + i % 10)}{w}{chr(107 + i % 10)}" for w in ("abo", "kin", "sul", "tre")] for i, n in enumerate(names)}
    rows = [(k * 70 + i, " ".join(words[n]) * 1 + " " + " ".join(reversed(words[n])), n) for i, n in enumerate(names) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["held_out"]) for r in L.identify(docs).collect()}
    assert {p for p, _ in got.values()} == set(names)
    assert sum(got[i][0] == n for i, _, n in rows) > 0.95 * len(rows)
