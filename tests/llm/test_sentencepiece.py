import os

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import sentencepiece_fst as T

MODEL = os.environ.get("PIECE_MODEL", T.MODEL_PATH)


@pytest.fixture(scope="module")
def fst():
    return T.Transducer(open(MODEL, "rb").read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


TEXTS = ["", " ", "  ", "a  b", " lead", "trail  ", "héllo\nworld\t日本😀", "\x00a", "a▁b", "▁▁x", "<s>hi<0x41></s>", "ÀÉ̀ ﬁ ½",
         "x" * 3000, " " * 50 + "y", "don't stop—now… 12345", "\u200b\ufeff", "the quick  brown   fox    jumps"]


def test_encoding_equals_the_library(fst, library):
    for t in TEXTS:
        assert fst.encode(t) == library.encode(t), t
        assert fst.decode(fst.encode(t)) == library.decode(library.encode(t)) or "▁" in t


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(blacklist_categories=("Cs",)), max_size=60) | st.text("ab thein▁. \n", max_size=80))
def test_any_text_round_trips_and_equals_the_library(t):
    fst, library = _both()
    assert fst.encode(t) == library.encode(t)
    assert fst.decode(fst.encode(t)) == t.replace("▁", " ")


_CACHE = []


def _both():
    if not _CACHE:
        _CACHE.append((T.Transducer(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)))
    return _CACHE[0]


def test_unigram_shortest_path_is_the_least_cost(fst):
    """A small unigram model: the path search against all segmentations."""
    import itertools
    import random
    rng = random.Random(1)
    m = T.Transducer(open(MODEL, "rb").read())
    m.kind, m.fallback = T.UNIGRAM, True
    m.pieces = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca"]
    m.scores = [0.0] + [-rng.random() * 5 for _ in m.pieces[1:]]
    m.ids = {p: i for i, p in enumerate(m.pieces) if i}
    m.least = min(m.scores)
    for n in range(1, 8):
        for w in itertools.islice(itertools.product("abc", repeat=n), 200):
            word = "▁" + "".join(w)
            cost = {0: 0.0}
            for end in range(1, len(word) + 1):
                cost[end] = min(cost[s] - m.scores[m.ids[word[s:end]]] for s in range(end) if word[s:end] in m.ids)
            got = m._score_path(word)
            assert "".join(m.pieces[i] for i in got) == word
            assert -sum(m.scores[i] for i in got) == pytest.approx(cost[len(word)])


def test_documents(spark, library):
    rows = [(i, t, "z") for i, t in enumerate(TEXTS)] + [(None, None, "z"), (3, "a  b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = T.encode_documents(df, MODEL).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in enumerate(TEXTS):
        assert list(by_id[i]["ids"]) == library.encode(t) and by_id[i]["n_pieces"] == len(by_id[i]["ids"])
        assert by_id[i]["round_trip"] == ("▁" not in t)
    assert by_id[None]["n_pieces"] == 0
    assert T.encode_documents(df.limit(0), MODEL).count() == 0
