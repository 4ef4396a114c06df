"""Language identification with a linear-chain conditional random field.

Words (runs of letters, lower-cased) are labelled with a language each, in runs
of up to ``RUN`` words, so a text that switches languages is labelled piecewise.
Features of a word: the word itself (a learned lexicon), its prefixes and
suffixes, and its byte n-grams, hashed to a fixed width; between neighbouring
words, learned transition weights. Training maximises the conditional
likelihood by forward-backward on a bounded sample of labelled rows; scoring
runs forward-backward over every word of every text and sums the marginals.
"""

from __future__ import annotations

import pickle
import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN = "und"
RUN = 64
WIDTH = 1 << 17
#: Training sample: documents per language, windows of words in all, words per window.
DOCS_PER_LANG, WINDOWS, WINDOW_WORDS = 500, 6000, 32
EPOCHS, RATE, DECAY = 30, 0.15, 1e-4
#: Texts are scored in groups of about this many characters; words remembered between groups.
GROUP_CHARS, REMEMBERED = 1_000_000, 500_000
_LETTERS = r"\p{L}+"


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # [WIDTH, langs]
    moves: np.ndarray  # [langs, langs]
    start: np.ndarray  # [langs]


def untrained() -> Crf:
    return Crf([], np.zeros((WIDTH, 0), np.float32), np.zeros((0, 0)), np.zeros(0))


def word_features(word: str) -> list[int]:
    """Hashed features of one word: itself, affixes and inner n-grams, with the word's ends marked."""
    b = b"^" + word.encode("utf-8", "surrogatepass") + b"$"
    n = len(b)
    grams = {b[i:i + k] for k in (2, 3, 4) for i in range(n - k + 1)}
    grams.update((b, b[:6], b[-6:], b[:5], b[-5:]))
    crc = zlib.crc32
    return [crc(g) % WIDTH for g in grams]


def word_scores(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Emission score of every word for every language."""
    flat: list[int] = []
    starts = []
    for w in words:
        starts.append(len(flat))
        flat.extend(word_features(w))
    if not words:
        return np.zeros((0, weights.shape[1]), np.float32)
    return np.add.reduceat(weights[np.array(flat)], np.array(starts), axis=0)


def forward_backward(scores: np.ndarray, mask: np.ndarray, moves: np.ndarray, start: np.ndarray,
                     pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals [runs, steps, langs] of runs padded to one length (mask: real words come first).

    With ``pairs`` also the expected number of moves between languages.
    """
    runs, steps, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    t = np.exp(moves)
    alpha = np.empty((steps, runs, k))
    a = np.exp(start) * e[:, 0]
    alpha[0] = a / a.sum(axis=1, keepdims=True)
    for i in range(1, steps):
        a = (alpha[i - 1] @ t) * e[:, i]
        a /= a.sum(axis=1, keepdims=True)
        alpha[i] = np.where(mask[:, i, None], a, alpha[i - 1])
    out = np.empty((runs, steps, k))
    beta = np.ones((runs, k))
    expected = np.zeros((k, k)) if pairs else None
    for i in range(steps - 1, -1, -1):
        g = alpha[i] * beta
        out[:, i] = g / g.sum(axis=1, keepdims=True)
        if i:
            eb = e[:, i] * beta
            if pairs:
                norm = ((alpha[i - 1] @ t) * eb).sum(axis=1)
                w = np.where(mask[:, i], 1.0 / norm, 0.0)
                expected += t * ((alpha[i - 1] * w[:, None]).T @ eb)
            b = eb @ t.T
            beta = np.where(mask[:, i, None], b / b.sum(axis=1, keepdims=True), beta)
    return out, expected


def spliced(windows: list[list[str]], labels: list[int], seed: int = 5) -> tuple[list[list[str]], list[list[int]]]:
    """Training runs: every window, half of them cut somewhere and continued by another one (a language switch)."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(windows))
    runs, tags = [], []
    for i, j in zip(order, np.roll(order, 1)):
        a, b = windows[i], windows[j]
        if rng.random() < 0.5 and len(a) > 3:
            cut = int(rng.integers(1, len(a)))
            rest = b[:len(a) - cut]
            runs.append(a[:cut] + rest)
            tags.append([labels[i]] * cut + [labels[j]] * len(rest))
        else:
            runs.append(a)
            tags.append([labels[i]] * len(a))
    return runs, tags


def train_crf(windows: list[list[str]], labels: list[str], epochs: int = EPOCHS) -> Crf:
    """Fit weights and transitions by adaptive gradient steps on the conditional log-likelihood."""
    langs = sorted(set(labels))
    k = len(langs)
    runs, tags = spliced(windows, [langs.index(x) for x in labels])
    index: dict[str, int] = {}
    ids = [[index.setdefault(w, len(index)) for w in r] for r in runs]
    steps = max(map(len, ids))
    words = np.zeros((len(ids), steps), np.int64)
    gold = np.zeros((len(ids), steps), np.int64)
    mask = np.zeros((len(ids), steps), bool)
    for r, (x, y) in enumerate(zip(ids, tags)):
        words[r, :len(x)], gold[r, :len(x)], mask[r, :len(x)] = x, y, True
    feats = [word_features(w) for w in index]
    flat = np.concatenate([np.array(f) for f in feats])
    sizes = np.array([len(f) for f in feats])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    truth = np.eye(k)[gold] * mask[:, :, None]
    true_moves = np.zeros((k, k))
    np.add.at(true_moves, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    weights, moves, start = np.zeros((WIDTH, k)), np.zeros((k, k)), np.zeros(k)
    sums = [np.full(p.shape, 1e-8) for p in (weights, moves, start)]
    n = mask.sum()
    for _ in range(epochs):
        emit = np.add.reduceat(weights[flat], starts, axis=0)
        post, expected = forward_backward(emit[words], mask, moves, start, pairs=True)
        diff = (truth - post * mask[:, :, None])
        per_word = np.stack([np.bincount(words[mask], weights=diff[:, :, c][mask], minlength=len(index))
                             for c in range(k)], axis=1)
        g_w = np.stack([np.bincount(flat, weights=np.repeat(per_word[:, c], sizes), minlength=WIDTH) for c in range(k)], axis=1)
        for p, s, g in zip((weights, moves, start), sums, (
                g_w / n - DECAY * weights, (true_moves - expected) / n - DECAY * moves, diff[:, 0].sum(axis=0) / n)):
            s += g * g
            p += RATE * g / np.sqrt(s)
    return Crf(langs, weights.astype(np.float32), moves, start)


class Tagger:
    """Scores texts with a trained model; remembers emission scores of words it has met."""

    def __init__(self, model: Crf):
        self.model = model
        self.find = regex.compile(_LETTERS).findall
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(model.langs)), np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        codes, unique = pd.factorize(np.array(words, dtype=object))
        if len(self.known) > REMEMBERED:
            self.known, self.table = {}, self.table[:0]
        fresh = [w for w in unique if w not in self.known]
        if fresh:
            for w in fresh:
                self.known[w] = len(self.known)
            self.table = np.concatenate([self.table, word_scores(fresh, self.model.weights)])
        return np.array([self.known[w] for w in unique], np.int64)[codes]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Mean marginal of each language over each text's words [texts, langs]; zeros for a text without letters."""
        m, out = self.model, np.zeros((len(texts), len(self.model.langs)))
        if not m.langs:
            return out
        words: list[str] = []
        counts = []
        for t in texts:
            found = self.find(t.lower()) if t else []
            counts.append(len(found))
            words += found
        if not words:
            return out
        ids, n = self._ids(words), np.array(counts)
        # runs of up to RUN words that never cross a text's end
        runs = -(-n // RUN)
        doc = np.repeat(np.arange(len(texts)), runs)
        first = np.repeat(np.cumsum(n) - n, runs) + RUN * (np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs))
        size = np.minimum(RUN, np.repeat(np.cumsum(n), runs) - first)
        at = first[:, None] + np.arange(RUN)
        mask = np.arange(RUN) < size[:, None]
        scores = self.table[ids[np.minimum(at, len(ids) - 1)]].astype(np.float64)
        post, _ = forward_backward(scores, mask, m.moves, m.start)
        sums = (post * mask[:, :, None]).sum(axis=1)
        np.add.at(out, doc, sums)
        return out / np.maximum(n, 1)[:, None]

    def label(self, texts: list[str | None]) -> pd.DataFrame:
        share = self.score(texts)
        best = share.argmax(axis=1) if len(self.model.langs) else np.zeros(len(texts), int)
        names = np.array([*self.model.langs, UNKNOWN], dtype=object)
        none = share.sum(axis=1) == 0
        top = share.max(axis=1, initial=0.0)
        return pd.DataFrame({"lang_pred": names[np.where(none, len(self.model.langs), best)],
                             "score": np.where(none, 0.0, np.minimum(top, 1.0))})


def in_groups(texts: list, chars: int = GROUP_CHARS) -> Iterator[list]:
    """Consecutive groups of about ``chars`` characters: bounds what is held at once whatever a batch brings."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def predictor(model: Crf, once: bool = False) -> Callable[[str], Column]:
    """Column function: text column -> struct(lang_pred, score).

    ``once`` keeps the optimizer from computing it anew for each use, as in a filter and in the projection above it.
    """
    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model)
        for batch in batches:
            parts = [tagger.label(g) for g in in_groups([t if isinstance(t, str) else None for t in batch])]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": [], "score": []})

    if once:
        predict = predict.asNondeterministic()
    return lambda col: predict(F.col(col).cast("string"))


def fit(docs: DataFrame, modulus: int = 4, held: int = 2, docs_per_lang: int = DOCS_PER_LANG,
        windows: int = WINDOWS) -> Crf:
    """Train on a bounded sample of the rows with a language whose crc32(doc_id) mod ``modulus`` is not ``held``.

    The sample is about ``docs_per_lang`` documents per language (chosen by a
    hash of the id), cut whole into windows of WINDOW_WORDS words, of which about ``windows`` are used, the same
    number of each language. Every labelled language is learned; the weights take half a megabyte per language. No
    labelled row: a model without languages, which labels everything ``und``.
    """
    usable = docs.select("lang", "doc_id", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()
                        & (fold("doc_id", modulus) != held))
    sizes = scratch(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n_lang")), "lang-sizes")
    n_langs = sizes.count()
    if not n_langs:
        return untrained()
    # as many rows as there are languages: broadcast unless they are very many
    per_lang = F.broadcast(sizes) if n_langs <= 10_000 else sizes
    share = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < F.lit(docs_per_lang * (1 << 30)) / F.col("n_lang")
    cut = usable.join(per_lang, "lang").where(share).select(
        "lang", "doc_id", F.regexp_extract_all(F.lower("text"), F.lit(_LETTERS), F.lit(0)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.size("w") - 1, F.lit(WINDOW_WORDS))
    rows = scratch(cut.select("lang", "doc_id", F.explode(F.transform(starts, lambda s: F.struct(
        s.alias("at"), F.slice("w", s + 1, WINDOW_WORDS).alias("words")))).alias("v")) \
        .select("lang", "v.words", F.xxhash64(F.lit(4), "doc_id", "v.at").alias("h")), "lang-windows")
    # equally many windows per language, the first by hash (a language's part of the sample is bounded); one task trains on them
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = rows.withColumn("rank", rank).where(F.col("rank") <= max(1, windows // n_langs)).drop("rank")
    fitted = picked.coalesce(1).mapInPandas(_train_task, "model binary").collect()
    return Crf(*pickle.loads(fitted[0]["model"])) if fitted else untrained()


def _train_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All windows of the sample -> one row with the trained model's parts."""
    frames = [b for b in batches if len(b)]
    if frames:
        sample = pd.concat(frames).sort_values(["lang", "h"])
        m = train_crf([list(w) for w in sample["words"]], sample["lang"].tolist())
        yield pd.DataFrame({"model": [pickle.dumps((m.langs, m.weights, m.moves, m.start))]})


def identify(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    ``lang_pred`` is a learned language, or ``und`` (score 0) when the text is null or has no letter;
    ``score`` is the mean marginal of that language over the text's words. Ties
    go to the language first by name. Null ids give a null held_out. Language and source are not read for scoring.
    """
    model = model or fit(docs)
    p = predictor(model)
    return docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), p("text").alias("p")) \
        .select("doc_id", "held_out", "p.lang_pred", "p.score")
