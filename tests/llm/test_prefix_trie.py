"""Prefix trie against a plain rebuilding of every conversation, and its SQL twin on hand-made rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskweave.llm import prefix_trie
from riskweave.llm.oracles import ORACLE
from test_oracles import duck

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]      # remainders take the sign of c, as in SQL
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    out = {}
    for path in sorted(nodes, key=len, reverse=True):
        members = sorted(nodes[path])
        ends = ",".join(str(c) for c in members if len(built[c]) == len(path))
        below = [out[k] for k in kids[path]]
        out[path] = {
            "conv_id": members[0], "depth": len(path), "parent_conv_id": min(nodes[path[:-1]]) if path else None, "n_convs": len(members),
            "n_children": len(below), "n_leaves": sum(b["n_leaves"] for b in below) or 1,
            "saved_tokens": sum(b["saved_tokens"] for b in below) + ((len(members) - 1) * len(path[-1][1]) if path else 0),
            "ends_sha256": hashlib.sha256(ends.encode()).hexdigest()}
    return sorted(out.values(), key=lambda r: (r["depth"], r["conv_id"]))


def trie(spark, rows):
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((r.asDict() for r in got), key=lambda r: (r["depth"], r["conv_id"]))


def made(seed=5):
    """Shared openings, exact copies, long unary chains, nulls, ties, repeated rows, a missing first conversation."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(205, 215), -7, 1000]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é😀", None, "", "long " * 9])))
    for c in range(300, 330):                       # copies from a shared stem, the last with a long tail
        rows += [(c, t, "user", f"stem {t}") for t in range(7)]
    rows += [(c, 7 + t, "user", f"tail {t}") for c in (310, 311) for t in range(70)]
    rows += [(5, None, "user", "first of all"), (5, 2, "user", "tie"), (5, 2, "user", "tie"), (5, 2, "user", "other"), (None, 1, "user", "lost")]
    rng.shuffle(rows)
    return rows


def test_trie_equals_brute_force(spark):
    rows = made()
    assert trie(spark, rows) == brute(rows)


def test_twin(spark):
    rows = [r for r in made(9) if r[0] is None or r[0] >= 0]
    cols = list(zip(*rows))
    table = pa.table({n: pa.array(v, t) for n, v, t in zip(("conv_id", "turn", "role", "text"), cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))})
    twin = sorted(duck(ORACLE["op11_prefix_trie"], conversations=table), key=lambda r: (r["depth"], r["conv_id"]))
    assert twin == brute(rows)


def test_empty_turnless_and_extra_columns(spark):
    assert trie(spark, []) == []
    # 3 heads of an absent first conversation: turnless when they have no turn beyond their head
    rows = [(c, 0, "user", "x") for c in (101, 102, 103, 104)]
    assert trie(spark, rows) == brute(rows)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "depth": F.lit("?"), "_hot": F.lit(2), "up": F.lit(3)})
    assert sorted(r["n_convs"] for r in prefix_trie.prefix_trie(frame).collect()) == sorted(r["n_convs"] for r in brute(rows))


@pytest.mark.parametrize("shape", ["chain", "star", "comb", "random"])
def test_contraction_totals(spark, shape):
    rng = random.Random(1)
    n = 150
    parent = {0: None}
    for v in range(1, n):
        parent[v] = {"chain": v - 1, "star": 0, "comb": v - 1 if v % 2 else max(0, v - 2), "random": rng.randrange(v)}[shape]
    depth = {0: 0}
    for v in range(1, n):
        depth[v] = depth[parent[v]] + 1
    kids = defaultdict(list)
    for v, p in parent.items():
        kids[p].append(v)
    value = {v: rng.randint(0, 9) for v in parent}

    def total(v):
        return value[v] + sum(map(total, kids[v]))

    def xor(xs):
        out = 0
        for x in xs:
            out ^= x
        return out
    table = spark.createDataFrame(
        [(v, depth[v], p, None if p is None else depth[p], len(kids[v]), xor(kids[v]), xor(depth[k] for k in kids[v]), int(not kids[v]), value[v])
         for v, p in parent.items()], "c long, d long, pc long, pd long, n long, xc long, xd long, leaves long, saved long")
    got = {r["c"]: r["saved"] for r in prefix_trie.subtree_totals(table, max(depth.values())).collect()}
    assert got == {v: total(v) for v in parent}
