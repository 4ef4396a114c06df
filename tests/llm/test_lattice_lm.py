"""Lattice probabilities against explicit segmentations, document scores against plain counting."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskweave.llm import lattice_lm

SCHEMA = "doc_id long, text string"
SPACES = " \t\n\x0b\x0c\r"


def all_paths(lattice, word):
    """Sum over explicitly listed segmentations."""
    def rest(at):
        if at == len(word):
            return 1.0
        total = 0.0
        for end in range(at + 1, len(word) + 1):
            piece = word[at:end]
            if piece in lattice.inner:
                total += math.exp(lattice.inner[piece]) * rest(end)
        if word[at] not in lattice.inner:
            total += math.exp(sum(lattice.spelled[b] for b in word[at].encode())) * rest(at + 1)
        return total
    return sum(math.exp(w) * rest(len(p)) for p, w in lattice.first.items() if word.startswith(p))


@pytest.fixture(scope="module")
def small():
    pieces = [("▁", -1.0), ("▁a", -2.0), ("a", -1.5), ("b", -2.5), ("ab", -1.2), ("aba", -3.0), ("▁ab", -2.2), ("é", -4.0)]
    return lattice_lm.lattice_of(pieces, [0.0] * 256, True, -4.0)


def test_marginal_sums_all_segmentations(small):
    for word in ["a", "ab", "abab", "aabbab", "é", "aéb", "xé", "a▁b", "😀"]:
        assert math.isclose(small.log_marginal(word), math.log(all_paths(small, word)), rel_tol=1e-12)
    assert small.log_marginal("ab" * 5000) < -5000               # far below what a double holds


def test_probabilities_sum_to_one(small):
    total = sum(math.exp(w) for part in (small.first, small.inner) for w in part.values()) + sum(map(math.exp, small.spelled)) + math.exp(small.end)
    assert math.isclose(total, 1.0)
    words = [""] + [a + b + c for a in "ab" for b in ["", *"ab"] for c in ["", *"ab"]]
    assert sum(math.exp(small.log_marginal(w)) for w in set(words)) + math.exp(small.end) < 1


def test_vocabulary_file():
    lattice = lattice_lm.read_lattice()
    assert len(lattice.first) > 5000 and len(lattice.inner) > 5000
    assert lattice.log_marginal("the") > lattice.log_marginal("thx") and lattice.log_marginal("͸") > -math.inf


def plain(rows, lattice):
    counts, docs = Counter(), 0
    for i, text in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update((text or "").encode().lower().split())
            docs += 1
    n, v = sum(counts.values()) + docs, len(counts) + (docs > 0)
    freq = Counter(counts.values()) + Counter([docs])
    d = freq[1] / (freq[1] + 2 * freq[2]) if freq[1] and freq[2] else 0.5
    out = []
    for i, text in rows:
        base = score = known = 0
        tokens = [*(text or "").encode().lower().split(), None]
        for t in tokens:
            c = docs if t is None else counts[t]
            m = lattice.end if t is None else lattice.log_marginal(t.decode())
            known += c > 0
            base += math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            score += math.log10(max(c - d, 0) / n + d * v / n * math.exp(m)) if n and (c or m > -700) else (m + (math.log(d * v / n) if n else 0)) / math.log(10)
        held = None if i is None else zlib.crc32(str(i).encode()) % 5 == 1
        out.append((i, held, len(tokens), known, n, base, score))
    return out


def made():
    rng = random.Random(2)
    words = ["the", "The", "of", "Étude", "étude", "x" * 40, "日本語", "a b", "a\u0085b", "😀", "naïve", "▁mark"] + [f"w{k}" for k in range(30)]
    rows = [(i, rng.choice(SPACES).join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    return rows + [(60, None), (61, ""), (62, " \t\n"), (7, rows[7][1]), (None, "the of"), (63, "unbroken" * 3000), (64, "the " * 5000)]


def check(got, wanted):
    def key(r):
        return (r[0] is None, r[0] or 0, r[2])
    got = sorted((tuple(r) for r in got), key=key)
    for a, b in zip(got, sorted(wanted, key=key), strict=True):
        assert a[:5] == b[:5]
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[5:], b[5:]))


@pytest.mark.parametrize("block", [10, 400_000])
def test_scores_equal_plain_counting(spark, monkeypatch, block):
    monkeypatch.setattr(lattice_lm, "BLOCK_WORDS", block)        # many small blocks give the same numbers
    rows = made()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"block": F.lit(1), "word": F.lit(2), "c": F.lit(3), "lead": F.lit(4)})
    check(lattice_lm.score_documents(frame).collect(), plain(rows, lattice_lm.read_lattice()))


def test_empty_and_untrained(spark):
    assert lattice_lm.score_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "the cat"), (None, None)]
    got = sorted(map(tuple, lattice_lm.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()), key=lambda r: r[2])
    lattice = lattice_lm.read_lattice()
    assert [r[:6] for r in got] == [(None, None, 1, 0, 0, 0.0), (None, None, 3, 0, 0, 0.0)]
    assert math.isclose(got[0][6], lattice.end / math.log(10))


def test_held_out_texts(spark):
    """The learned words make held-out texts likelier than the vocabulary alone does, and texts likelier than their words reversed."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("text IS NOT NULL")
    held = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 and r["text"].split()]
    lattice = lattice_lm.read_lattice()
    turned = [(10**9 + r["doc_id"] * 2**20 + k, " ".join(w[::-1] for w in r["text"].split()))
              for r in held for k in [next(k for k in range(2**20) if zlib.crc32(str(10**9 + r["doc_id"] * 2**20 + k).encode()) % 5 == 1)]]
    both = docs.unionByName(spark.createDataFrame(turned, SCHEMA))
    score = {r["doc_id"]: r["score"] for r in lattice_lm.score_documents(both).where("held_out").collect()}
    alone = sum(sum(lattice.log_marginal(t.decode()) for t in r["text"].encode().lower().split()) + lattice.end for r in held) / math.log(10)
    assert sum(score[r["doc_id"]] for r in held) > alone
    assert sum(score[r["doc_id"]] > score[o] for r, (o, _) in zip(held, turned)) > 0.9 * len(held)
