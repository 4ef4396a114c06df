"""Toxicity: gradient-boosted trees over dense text features, isotonic calibration.

Features: densities of a fixed and a learned lexicon (words and word
beginnings that mark toxic training texts), how often a hit stands near a second-person
word, capitals, punctuation, and spellings that hide letters. A bounded
sample of labelled rows is dealt into parts: two for the lexicon, two for the
trees, one for the calibration, so no step judges texts an earlier one has learned,
except those of a class with very few labels, which the steps share.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, scratch, text_or_empty
from .labelled import Sample, labelled_sample

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 15_000
THRESHOLD = 0.3
#: Lexicon entries: texts that must show it, least log ratio of the classes, number kept.
LEAST_TEXTS, LEAST_RATIO, LEXICON = 4, math.log(4.0), 4000
STEMS = (4, 5, 6, 7)
TREES, DEPTH = 30, 3
NEAR = 5
REMEMBERED = 400_000
#: Fixed insults in English and second-person words of the corpus languages.
INSULTS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown",
           "dumb", "fool", "jerk", "hate", "ugly", "filthy", "garbage", "bastard", "vermin", "imbecile")
SECOND_PERSON = ("you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi",
                 "te", "ton", "ta", "vous", "votre", "tú", "ti", "usted", "ustedes", "vosotros")
FEATURES = ("fixed_density", "fixed_hits", "word_density", "word_max", "word_hits", "stem_density", "stem_max",
            "stem_hits", "near_second_person", "second_person", "capitals", "punctuation", "exclamations",
            "hidden", "stretched", "length")


def learned_lexicon(sample: DataFrame) -> dict[str, float]:
    """Words (``w:``) and word beginnings (``s:``) of the sample's texts -> log ratio of toxic to clean shares."""
    totals = sample.agg(F.sum("y"), F.count(F.lit(1))).first()
    toxic, clean = int(totals[0] or 0), int(totals[1]) - int(totals[0] or 0)
    if not toxic or not clean:
        return {}
    found = sample.withColumn("row", F.monotonically_increasing_id()).select("row", "y", F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("w"))
    stems = [F.when(F.char_length("w") >= k, F.concat(F.lit("s:"), F.substring("w", 1, k))) for k in STEMS]
    terms = found.select("row", "y", F.explode(F.array_compact(F.array(F.concat(F.lit("w:"), F.col("w")), *stems))).alias("term"))
    # a beginning counts once per text, however many words of the text share it
    per_text = terms.groupBy("row", "term").agg(F.max("y").alias("y"))
    counts = per_text.groupBy("term").agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).where(F.col("t") >= LEAST_TEXTS)
    ratio = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    top = counts.withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO) \
        .orderBy(F.desc(F.col("ratio") * F.sqrt("t")), "term").limit(LEXICON)
    return {r["term"]: float(r["ratio"]) for r in top.collect()}


CAPITAL, LETTER, MARK, HIDING = 1, 2, 4, 8


def _character_kind(c: str) -> int:
    letter = unicodedata.category(c)[0]
    return (CAPITAL * c.isupper() | LETTER * (letter == "L") | MARK * (letter in "PS") | HIDING * (c in "0123456789@$*#!"))


class Measure:
    """Dense features of texts."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.words = regex.compile(r"\p{L}+").findall
        self.hidden = regex.compile(r"(?<=\p{L})[0-9@$*#!]+(?=\p{L})").findall
        self.kind = np.array([_character_kind(chr(c)) for c in range(1 << 16)], np.uint8)
        self.fixed, self.second = frozenset(INSULTS), frozenset(SECOND_PERSON)
        self.known: dict[str, tuple | None] = {}

    def _word(self, w: str) -> tuple | None:
        """(fixed, word ratio, stem ratio, second person) of a word; None: says nothing."""
        get = self.lexicon.get
        stem = max((get(f"s:{w[:k]}", 0.0) for k in STEMS if len(w) >= k), default=0.0)
        v = (w in self.fixed, get(f"w:{w}", 0.0), stem, w in self.second)
        return v if any(v) else None

    def __call__(self, text: str) -> list[float]:
        words = self.words(text.lower())
        n = max(len(words), 1)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        hits = []
        for i, w in enumerate(words):
            if w in known:
                v = known[w]
            else:
                v = known[w] = self._word(w)
            if v is not None:
                hits.append((i, v))
        you = np.array([i for i, v in hits if v[3]])
        bad = np.array([i for i, v in hits if v[0] or v[1] or v[2]])
        near = 0
        if len(you) and len(bad):
            at = np.searchsorted(you, bad)
            gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - bad), np.abs(you[np.maximum(at - 1, 0)] - bad))
            near = int((gap <= NEAR).sum())
        fixed = sum(1 for _, v in hits if v[0])
        word = [v[1] for _, v in hits if v[1]]
        stem = [v[2] for _, v in hits if v[2]]
        chars = max(len(text), 1)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[np.minimum(code, len(self.kind) - 1)]
        same = (code[1:] == code[:-1]) & (kind[1:] & LETTER > 0)
        stretched = int((same[1:] & same[:-1]).sum())
        hidden = len(self.hidden(text)) if (kind & HIDING).any() else 0
        return [fixed / n, math.log1p(fixed), sum(word) / n, max(word, default=0.0), math.log1p(len(word)),
                sum(stem) / n, max(stem, default=0.0), math.log1p(len(stem)), near / n, len(you) / n,
                int((kind & CAPITAL > 0).sum()) / chars, int((kind & MARK > 0).sum()) / chars, text.count("!") / n,
                hidden / n, stretched / n, math.log1p(len(words))]


def featurizer(lexicon: dict[str, float]):
    """Column function: text column -> array<double> of FEATURES."""
    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measure = Measure(lexicon)
        for batch in batches:
            yield pd.Series([measure(t) for t in batch], dtype=object)

    return lambda col: features(text_or_empty(col))


class ToxicityModel:
    """Lexicon, trees and calibration, or a constant when the labels show a single class."""

    def __init__(self, lexicon, trees, calibration, base: float):
        self.lexicon, self.trees, self.calibration, self.base = lexicon, trees, calibration, base

    def score(self, docs: DataFrame, keep: list[Column]) -> DataFrame:
        """``keep`` and ``score``, for the column ``text`` of ``docs``."""
        if self.trees is None:
            return docs.select(*keep, F.lit(self.base).alias("score"))
        x = docs.select(*keep, array_to_vector(featurizer(self.lexicon)("text")).alias("_x"))
        kept = [c for c in x.columns if c != "_x"]
        p = self.trees.transform(x).select(*kept, vector_to_array("_probability")[1].alias("_p"))
        return self.calibration.transform(p).select(*kept, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_score"))).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held: int = 2,
        rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on about ``rows`` labelled documents outside the held-out fold (a documented bound, see ``labelled_sample``)."""
    sample = labelled_sample(docs, labels, label, modulus, held, rows)
    if not sample.both:
        return ToxicityModel({}, None, None, sample.base)
    lexicon = learned_lexicon(sample.part(0, 1))
    x = Sample(scratch(sample.part(2, 3, 4).select("parts", "w", F.col("y").cast("double").alias("y"),
                                                   featurizer(lexicon)("text").alias("v")), "toxic-features")
               .withColumn("_x", array_to_vector("v")), sample.base, True)
    learner = GBTClassifier(featuresCol="_x", labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7,
                            predictionCol="_tree")
    trees = learner.setProbabilityCol("_probability").setRawPredictionCol("_raw").fit(x.part(2, 3))
    judged = trees.transform(x.part(4)).select("y", "w", F.round(vector_to_array("_probability")[1], 3).alias("_p"))
    # one weighted point per score and class: the calibration sees at most 2,002 rows, classes in their true proportion
    points = judged.groupBy("_p", "y").agg(F.sum("w").alias("w"))
    calibration = IsotonicRegression(featuresCol="_p", labelCol="y", weightCol="w", predictionCol="_score").fit(points)
    return ToxicityModel(lexicon, trees, calibration, sample.base)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: ToxicityModel | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null text counts as empty and gets a score like any other. Null ids give a
    null held_out. Without labels of both classes the score is their constant share (0 without any).
    """
    model = model or fit(docs, labels)
    scored = model.score(docs, [F.col("doc_id"), (fold("doc_id", 4) == 2).alias("held_out")])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
