"""SentencePiece encoding and decoding by shortest paths in a weighted transducer.

Compiled from a model file: the normaliser (a leading mark, spaces written as
marks), the pieces with their scores, and the fallback that spells an unknown
character as bytes. Composing with an input gives a lattice whose arcs are
the pieces that occur at a place; a shortest path under the tropical semiring
(costs add, the least wins) is the encoding.

Unigram models: an arc costs the negative score of its piece. Pair models: the
states also remember the last piece, and the arc from piece a to piece b costs
0 if merging the text of a followed by b ends in exactly these two pieces,
else infinity. An encoding is the only finite path all of whose neighbours are so
compatible: the first merge across a boundary would also happen when the two
neighbours are merged alone, so it is ruled out, and then each piece must form
by itself. Every prefix has one encoding, hence one finite state per place.

Pieces never hold a mark after another character, so a path's cost splits at
the words' marks; words are composed one by one and remembered.
"""

from __future__ import annotations

import hashlib
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
GROUP_CHARS, REMEMBERED, PAIRS_REMEMBERED = 1_000_000, 400_000, 1_000_000

ENCODED_SCHEMA = "doc_id bigint, n_pieces bigint, ids array<int>, text_sha256 string, round_trip boolean"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a serialised message: varints as int, 4 byte values and blobs as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at:at + size]
            at += size


class Transducer:
    """A compiled model. ``encode`` and ``decode`` are inverse up to the normaliser."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.prefix, self.squeeze, self.escape = UNIGRAM, True, True, True
        fallback = False
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode("utf-8"))
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.types.append(f.get(3, NORMAL))
            elif number == 2:
                f = dict(_fields(value))
                self.kind, fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2):
                    raise ValueError("only models with the identity character map are supported")
                self.prefix, self.squeeze, self.escape = (bool(f.get(n, 1)) for n in (3, 4, 5))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and pair models are supported")
        if USER_DEFINED in self.types or not self.escape:
            raise ValueError("models with user-defined pieces or unescaped spaces are not supported")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == NORMAL}
        self.longest = max(map(len, self.ids), default=1)
        if any(MARK in p[1:] and p.strip(MARK) for p in self.ids):
            raise ValueError("pieces that cross a word's start are not supported")
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = [0] * 256
        if fallback:
            for i, (p, t) in enumerate(zip(self.pieces, self.types)):
                if t == BYTE:
                    self.bytes[int(p[3:-1], 16)] = i
        self.fallback = fallback
        self.spelled = [self._spelling(i) for i in range(len(self.pieces))]
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        self.least = min((s for s, t in zip(self.scores, self.types) if t == NORMAL), default=0.0)
        self.words = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = regex.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def _merged(self, text: str) -> list[str]:
        """What merging the best-scored neighbours, leftmost first, makes of a short text."""
        parts = list(text)
        ids, scores = self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                p = ids.get(parts[i] + parts[i + 1])
                if p is not None and (best is None or scores[p] > best):
                    best, at = scores[p], i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, a: int, b: int) -> bool:
        """Cost of the arc from piece a to piece b is 0 (a < 0: b starts afresh)."""
        if a < 0:
            ok = self.whole.get(b)
            if ok is None:
                ok = self.whole[b] = self._merged(self.pieces[b]) == [self.pieces[b]]
            return ok
        key = a * len(self.pieces) + b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > PAIRS_REMEMBERED:
                self.pairs.clear()
            x, y = self.pieces[a], self.pieces[b]
            ok = self.pairs[key] = self._merged(x + y) == [x, y]
        return ok

    def _spell(self, char: str) -> list[int]:
        if not self.fallback:
            return [self.unknown]
        return [self.bytes[b] for b in char.encode("utf-8", "replace")]

    def _pair_path(self, word: str) -> list[int]:
        """The one path of finite cost, found depth first, longer arcs first.

        A place reached over compatible arcs is reached in its only finite
        state, so a place that leads nowhere is never tried again.
        """
        trie, n, pairs, compatible, size = self.trie, len(word), self.pairs, self._compatible, len(self.pieces)
        dead: set[int] = set()
        path: list[tuple[int, int]] = []  # (start, piece; -1: a spelled character)
        at, last = 0, -1
        while at < n:
            node, ends, i = trie, [], at
            while i < n:
                node = node.get(word[i])
                if node is None:
                    break
                i += 1
                p = node.get("")
                if p is not None:
                    ends.append((i, p))
            step = None
            if not ends and word[at] not in self.ids:
                step = at + 1, -1
            while ends and step is None:
                end, p = ends.pop()
                if end in dead:
                    continue
                ok = pairs.get(last * size + p) if last >= 0 else None
                if compatible(last, p) if ok is None else ok:
                    step = end, p
            if step is None:  # infinite cost from here on: take back the last arc
                dead.add(at)
                at, _ = path.pop()
                last = path[-1][1] if path else -1
                continue
            path.append((at, step[1]))
            at, last = step
        out: list[int] = []
        for start, p in path:
            if p < 0:
                out += self._spell(word[start])
            else:
                out.append(p)
        return out

    def _score_path(self, word: str) -> list[int]:
        """Least cost by piece scores; an unknown character costs more than any piece."""
        ids, scores = self.ids, self.scores
        cost = [0.0] + [float("inf")] * len(word)
        came = [(0, -1)] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                p = ids.get(word[start:end])
                if p is None and end - start > 1:
                    continue
                c = cost[start] + (10.0 - self.least if p is None else -scores[p])
                if c < cost[end]:
                    cost[end], came[end] = c, (start, -1 if p is None else p)
        out, end = [], len(word)
        while end:
            start, p = came[end]
            out.append(self._spell(word[start:end]) if p < 0 else [p])
            end = start
        return [i for x in reversed(out) for i in x]

    def _path(self, word: str) -> bytes:
        """Encoding of a word; the words of the last two generations are remembered."""
        found = self.known.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                path = (self._pair_path if self.kind == BPE else self._score_path)(word)
                found = struct.pack(f"={len(path)}i", *path)
            if len(self.known) > REMEMBERED:
                self.known, self.older = {}, self.known
            self.known[word] = found
        return found

    def encode_words(self, text: str) -> bytes:
        """Piece ids of a text as 32-bit integers."""
        norm = self.normalise(text)
        words = norm.split(MARK)
        # the plain case: one mark before each word; else words keep their runs of marks
        if words[0] or "" in words[1:]:
            words = self.words(norm)
        else:
            words = [MARK + w for w in words[1:]]
        found = [*map(self.known.get, words)]
        if None in found:
            found = [self._path(w) if f is None else f for f, w in zip(found, words)]
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_words(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """Bytes join to characters, marks become spaces, the leading mark goes. Control pieces say nothing."""
        text = b"".join([*map(self.spelled.__getitem__, ids)]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def _spelling(self, i: int) -> bytes:
        kind = self.types[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:-1], 16)])
        if kind == UNKNOWN:
            return " \u2047 ".encode()
        return b"" if kind == CONTROL else self.pieces[i].replace(MARK, " ").encode("utf-8")


def encode_documents(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """One row per input row: doc_id, n_pieces, ids, text_sha256, round_trip.

    ``round_trip``: decoding the ids gives the text back (a text that itself
    holds U+2581 comes back with spaces there). Null and empty texts have no
    pieces. The model (under 1 MB) is read on the driver and goes to the tasks by
    value. Every text is encoded whole.
    """
    with open(model_path, "rb") as f:
        model = f.read()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = Transducer(model)
        for batch in batches:
            at = 0
            ids, texts = batch.column(0), batch.column(1)
            while at < len(texts):
                flat, ends, same, shas, size, first = [], [0], [], [], 0, at
                while at < len(texts) and size < GROUP_CHARS:
                    text = texts[at].as_py()
                    found = np.frombuffer(fst.encode_words(text), np.int32)
                    flat.append(found)
                    ends.append(ends[-1] + len(found))
                    same.append(fst.decode(found.tolist()) == text)
                    shas.append(hashlib.sha256(text.encode("utf-8", "replace")).hexdigest())
                    size += len(text)
                    at += 1
                values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(first, at - first), pa.array(np.diff(ends), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(shas), pa.array(same)],
                    names=["doc_id", "n_pieces", "ids", "text_sha256", "round_trip"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")) \
        .mapInArrow(encode, ENCODED_SCHEMA)
