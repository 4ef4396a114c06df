"""Log-probabilities of documents: a subword lattice over an existing vocabulary, with words learned from the corpus.

*Lattice.* The arcs over a word are the vocabulary's pieces that occur in it, the first with the
mark of a word's start; a character without a piece is spelled as bytes. The vocabulary's own scores weigh
the arcs, and a forward recursion in log space adds up all segmentations:
f(j) = log sum over pieces w[i:j] of exp(f(i) + log p(piece)), f(end) the word's marginal. Scores of a unigram model are log-probabilities.
A pair model's score is minus the rank of its merge; pieces of rank r get p proportional to 1 / (r + 1)
(Zipf's law), bytes stand behind the last rank. The probabilities sum to 1 over all usable pieces and the end of a document, and no piece
crosses a word's start, so a text's marginal is the product over its words, and those of all words and the end sum to at most 1.

*Corpus.* A word seen in training documents is one more arc over its whole length. With c its count, N the tokens,
V the distinct ones, n1 and n2 the tokens seen once and twice, D = n1 / (n1 + 2 n2) (absolute discounting by its leave-one-out estimate):

    P(word) = max(c - D, 0) / N + D V / N * marginal(word)

Both parts sum to 1, and so does P over words and the end. Nothing is trained but these counts; the vocabulary stays as it is.

*Job.* Documents are cut into blocks of bounded vocabulary in one pass (Arrow); a block is written as its distinct words, once each, and
its documents as places in that list. The words of all blocks meet by word for their counts and marginals (once per distinct word), go back to
their block as numbers, and are summed per document. A very common word has one row per block; nothing is broadcast but the piece table.

Cases: null text is empty (one token, the end); null ids are scored but teach nothing and have a null ``held_out``; repeated rows count
as often as they occur; without training tokens P is the marginal alone and the base score is 0. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, fold, scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: A block ends with the document that brings it to this many distinct words or bytes of text.
BLOCK_WORDS, BLOCK_BYTES = 400_000, 32_000_000
#: Fixed values of the model format: the kind of a unigram model in its trainer's settings.
_TRAINER, _KIND, _UNIGRAM = 2, 3, 1
_BLOCK_SCHEMA = "block string, word binary, slot int, trained bigint, doc_id bigint, learn boolean, slots array<int>, times array<int>"


class Lattice:
    """Arcs of a vocabulary with natural-log weights: ``log_marginal`` sums all segmentations of a word."""

    def __init__(self, first: dict[str, float], inner: dict[str, float], spelled: list[float], end: float):
        self.first, self.inner, self.spelled, self.end = first, inner, spelled, end
        self.alone = first.get("", -math.inf)
        self.longest = max(map(len, [*first, *inner]), default=1)

    def log_marginal(self, word: str) -> float:
        longest, first, inner = self.longest, self.first.get, self.inner.get
        f = [self.alone]
        for j, char in enumerate(word, 1):
            terms = []
            if j <= longest and (w := first(word[:j])) is not None:
                terms.append(w)
            for i in range(max(0, j - longest), j):
                if (w := inner(word[i:j])) is not None:
                    terms.append(f[i] + w)
            if char not in self.inner:
                terms.append(f[j - 1] + sum(self.spelled[b] for b in char.encode()))
            if len(terms) == 1:
                f.append(terms[0])
                continue
            top = max(terms, default=-math.inf)
            f.append(top if top == -math.inf else top + math.log(sum([math.exp(t - top) for t in terms])))
        return f[-1]


def read_lattice(path: str = MODEL_PATH) -> Lattice:
    """The lattice of a SentencePiece model file (read on the driver; executors get the arcs)."""
    import sentencepiece

    from .sentencepiece_fst import _fields

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as file:
        trainer = next((dict(_fields(v)) for n, v in _fields(file.read()) if n == _TRAINER), {})
    unigram = trainer.get(_KIND, _UNIGRAM) == _UNIGRAM
    pieces, bytes_, last = [], [0.0] * 256, 0.0
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_[int(piece[3:-1], 16)] = model.get_score(i)
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and MARK not in piece[1:]:
            pieces.append((piece, model.get_score(i)))
            last = min(last, pieces[-1][1])
    return lattice_of(pieces, bytes_, unigram, last)


def lattice_of(pieces: list[tuple[str, float]], bytes_: list[float], unigram: bool, last: float) -> Lattice:
    """Weights that sum to 1 over pieces, bytes and the end; the end weighs as much as the average piece that starts a word."""
    if unigram:
        weights = [s for _, s in pieces]
        spelled = [s or last for s in bytes_]
    else:
        weights = [-math.log1p(-s) for _, s in pieces]
        spelled = [-math.log1p(1 - last)] * 256
    begins = [w for (p, _), w in zip(pieces, weights) if p.startswith(MARK)]
    end = math.log(sum(map(math.exp, begins)) / len(begins)) if begins else 0.0
    total = math.log(sum(map(math.exp, [*weights, *spelled, end])))
    first = {p[1:]: w - total for (p, _), w in zip(pieces, weights) if p.startswith(MARK)}
    inner = {p: w - total for (p, _), w in zip(pieces, weights) if not p.startswith(MARK)}
    return Lattice(first, inner, [s - total for s in spelled], end - total)


def _write_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, learn, text) -> the blocks' words and documents, in rows of one table."""
    import uuid

    from pyspark import TaskContext

    schema = pa.schema([("block", pa.string()), ("word", pa.binary()), ("slot", pa.int32()), ("trained", pa.int64()), ("doc_id", pa.int64()),
                        ("learn", pa.bool_()), ("slots", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])
    context = TaskContext.get()
    name = f"{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
    count = 0

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def label(n: int) -> pa.Array:
        return pa.array([f"{name}-{count}"] * n)

    slot_of: dict[bytes, int] = {}
    trained: Counter = Counter()
    size = 0

    def words() -> Iterator[pa.RecordBatch]:
        every = list(slot_of)
        for at in range(0, len(every), 50_000):
            part = every[at:at + 50_000]
            yield rows(len(part), block=label(len(part)), word=pa.array(part, pa.binary()), slot=pa.array(range(at, at + len(part))),
                       trained=pa.array([trained.get(w, 0) for w in part]))

    for batch in batches:
        docs: list[tuple] = []

        def written() -> pa.RecordBatch:
            slots = pa.ListArray.from_arrays(np.cumsum([0, *[len(d[2]) for d in docs]], dtype=np.int32), np.concatenate([d[2] for d in docs] or [np.zeros(0, np.int32)]))
            times = pa.ListArray.from_arrays(np.cumsum([0, *[len(d[3]) for d in docs]], dtype=np.int32), np.concatenate([d[3] for d in docs] or [np.zeros(0, np.int32)]))
            return rows(len(docs), block=label(len(docs)), doc_id=pa.array([d[0] for d in docs], pa.int64()), learn=pa.array([d[1] for d in docs], pa.bool_()),
                        slots=slots, times=times)

        for doc_id, learn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            # bytes: lower() takes A-Z only, split() exactly the white space of the contract
            data = (text.as_py() or "").encode().lower()
            found = Counter(data.split())
            if learn:
                trained.update(found)
            docs.append((doc_id, learn, np.fromiter((slot_of.setdefault(w, len(slot_of)) for w in found), np.int32, len(found)),
                         np.fromiter(found.values(), np.int32, len(found))))
            size += len(data)
            if len(slot_of) >= BLOCK_WORDS or size >= BLOCK_BYTES:
                yield written()
                yield from words()
                docs, slot_of, trained, size, count = [], {}, Counter(), 0, count + 1
        if docs:
            yield written()
    yield from words()


def _marginals(lattice: Lattice):
    """Rows sorted by word -> natural-log marginal of each, computed once per run of equal words."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, value = None, 0.0
        for batch in batches:
            out = []
            for w in batch.column(0).to_pylist():
                if w != word:
                    word, value = w, lattice.log_marginal(w.decode())
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.float64())],
                                             [*batch.schema.names[1:], "marginal"])
    return work


def _score_block(counts: dict):
    """A block's words (slot, c, marginal) and documents -> the documents' sums."""
    tokens, types, discount, docs = counts["tokens"], counts["types"], counts["discount"], counts["docs"]
    base_unit = math.log10(tokens + 0.5 * (types + 1))

    def logs(c: np.ndarray, marginal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = np.log10(c + 0.5) - base_unit
        if not tokens:
            return base, marginal / math.log(10)
        spare = discount * types / tokens
        with np.errstate(divide="ignore"):
            seen = np.log(np.maximum(c - discount, 0) / tokens)
            rest = np.log(spare) + marginal
        return base, np.logaddexp(seen, rest) / math.log(10)

    end_base, end_score = (float(v[0]) for v in logs(np.array([float(docs)]), np.array([counts["end"]])))

    def work(words: pa.Table, papers: pa.Table) -> pa.Table:
        slot = words.column("slot").to_numpy()
        order = np.argsort(slot)
        c = words.column("c").to_numpy()[order].astype(np.float64)
        base, score = logs(c, words.column("marginal").to_numpy()[order])
        slots, times = (papers.column(x).combine_chunks() for x in ("slots", "times"))
        sizes = pc.list_value_length(slots).to_numpy().astype(np.int64)
        flat, weight = slots.flatten().to_numpy(), times.flatten().to_numpy().astype(np.float64)
        owner = np.repeat(np.arange(len(sizes)), sizes)

        def summed(values: np.ndarray) -> np.ndarray:
            return np.bincount(owner, values, len(sizes))

        n_tokens = summed(weight).astype(np.int64) + 1
        n_known = summed(weight * (c[flat] > 0)).astype(np.int64) + (docs > 0)
        return pa.table({"doc_id": papers.column("doc_id"), "n_tokens": n_tokens, "n_known": n_known,
                         "base_score": summed(weight * base[flat]) + end_base, "score": summed(weight * score[flat]) + end_score})
    return work


def score_documents(documents: DataFrame, modulus: int = 5, held: int = 1, model_path: str = MODEL_PATH) -> DataFrame:
    """Per document: token counts, the base model's and the lattice model's log10 probability."""
    lattice = read_lattice(model_path)
    spark = documents.sparkSession
    learn = F.coalesce(fold("doc_id", modulus) != held, F.lit(False))
    blocks = scratch(documents.select(F.col("doc_id").cast("long").alias("doc_id"), learn.alias("learn"), F.col("text").cast("string").alias("text"))
                     .mapInArrow(_write_blocks, _BLOCK_SCHEMA), "lm-blocks")
    words, papers = blocks.where("word IS NOT NULL"), blocks.where("word IS NULL")
    # all rows of a word meet (one per block); the window spills, the sorted rows feed the lattice
    by_word = Window.partitionBy("word")
    meeting = words.select("word", "block", "slot", "trained").withColumn("c", F.sum("trained").over(by_word)) \
        .withColumn("lead", F.row_number().over(by_word.orderBy("block")) == 1)
    valued = scratch(meeting.select("word", "block", "slot", "c", "lead").mapInArrow(
        _marginals(lattice), "block string, slot int, c bigint, lead boolean, marginal double"), "lm-words")
    told = valued.where("lead AND c > 0").agg(F.sum("c"), F.count(F.lit(1)), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
    docs = papers.where("learn").count()
    ends = [docs == k for k in (1, 2)]
    once, twice = told[2] + ends[0], told[3] + ends[1]
    counts = {"tokens": (told[0] or 0) + docs, "types": told[1] + (docs > 0), "docs": docs, "end": lattice.end,
              "discount": once / (once + 2 * twice) if once and twice else 0.5}
    scored = valued.select("block", "slot", "c", "marginal").groupBy("block").cogroup(papers.select("block", "doc_id", "slots", "times").groupBy("block")) \
        .applyInArrow(_score_block(counts), "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", (fold("doc_id", modulus) == held).alias("held_out"), "n_tokens", "n_known",
                         F.lit(counts["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
