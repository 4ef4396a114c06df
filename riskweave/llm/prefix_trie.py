"""Prefix trie of conversations, its subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns; conversations that share it meet
there once, so a node's later members need not be processed again.

*Nodes.* A turn becomes the SHA-256 of its role and text. The key of a prefix is
the sum, over its places, of a hash of place and digest, in five lanes of 24
bits: running sums over one global order (conversation, place), so a conversation of any length is
spread over many tasks, and the parent's key is the difference to the last turn.
A node is named by its smallest member and its depth, a pair no other node has.

*Contraction.* A row per live node holds its parent, the number and the XOR of
its live children's names (with one child: that child's name), what its
removed children gave it, and what its edge adds on the way to the parent. A round
of joins rakes all leaves into their parents, then compresses unary chains:
of the nodes with one child those go whose depth has this round's bit set and
whose parent does not go as well; the child moves up to the parent and
its edge takes over the total of the removed node. Of two neighbours of a
chain the depths differ, so within a cycle of bits one of them goes: rounds grow
with the logarithm of nodes and depth, not with the depth. Sums to a parent
are partial aggregations, all other messages have unique keys, so a node
with a third of all nodes below it is no hot key.

*Expansion.* A compressed node's total is its own part plus the total of the
child it had; those links are jumped, a few rounds, until every total is known.

Cases: null role or text is empty; null turns come first; turns of the same number are
ordered by their digests; remainders of negative conv_ids are negative, as in SQL; rows without conv_id belong to no conversation;
an empty table has no node, not even the root. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import prefix_sums
from .common import attach, drop_scratch, scratch, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Conversations of a block start with turns of the block's first one.
BLOCK, MOST_HEAD = 100, 5
LANES, LANE_BITS = 5, 24
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_ROOT_KEY = "0" * (LANES * LANE_BITS // 4)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, digest, chars) of every turn, by turn (nulls first) and digest."""
    role, text = text_or_empty("role"), text_or_empty("text")
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.char_length(text).cast("long").alias("chars"), F.lit(1).alias("one"))
    ranked = prefix_sums(turns, ["conv_id"], [F.col("turn"), F.col("digest")], ["turn", "digest"], ["one"])
    return ranked.select("conv_id", F.col("cum_one").cast("long").alias("pos"), "digest", "chars")


def _head(conv_id: str) -> Column:
    return F.crc32(F.col(conv_id).cast("string")) % (MOST_HEAD + 1)


def spliced_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv_id, length) of each, and their turns (conv_id, pos, digest, chars).

    The first h turns are those of the block's first conversation, the rest are the own
    turns after the first h. ``turns`` must be a written table.
    """
    sizes = scratch(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "trie-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    first = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).join(first, "base", "left") \
        .withColumn("head", F.least(_head("conv_id"), F.coalesce("n_base", F.lit(0)))) \
        .select("conv_id", "base", "n", "head", (F.col("head") + F.greatest(F.col("n") - _head("conv_id"), F.lit(0))).alias("length"))
    convs = scratch(convs, "trie-conversations")
    lead = turns.where((F.col("pos") <= MOST_HEAD) & (F.col("conv_id") % BLOCK == 0)).withColumnRenamed("conv_id", "base")
    lead = convs.select("conv_id", "base", "head").join(lead, "base").where("pos <= head") \
        .select("conv_id", "pos", "digest", "chars")
    own = attach(turns.where(F.col("pos") > _head("conv_id")), convs.select("conv_id", "n", "head"), "conv_id", "n", total)
    own = own.select("conv_id", (F.col("pos") - _head("conv_id") + F.col("head")).alias("pos"), "digest", "chars")
    return convs, lead.unionByName(own)


def _key(lanes: list[Column]) -> Column:
    return F.concat(*[F.lpad(F.hex(F.pmod(v.cast("long"), F.lit(1 << LANE_BITS))), LANE_BITS // 4, "0") for v in lanes])


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, chars) -> with ``key`` of the prefix that ends there and ``up``, the key of the prefix before."""
    mask = (1 << LANE_BITS) - 1
    lanes = [f"l{i}" for i in range(LANES)]
    hashed = [F.xxhash64(F.lit(i), "pos", "digest") for i in range((LANES + 1) // 2)]
    turns = turns.select("conv_id", "pos", "chars", *[
        F.shiftrightunsigned(hashed[i // 2], LANE_BITS * (i % 2)).bitwiseAND(F.lit(mask)).alias(c) for i, c in enumerate(lanes)])
    summed = prefix_sums(turns, ["conv_id"], [F.col("pos")], ["pos"], lanes)
    return summed.select("conv_id", "pos", "chars", _key([F.col(f"cum_{c}") for c in lanes]).alias("key"),
                         _key([F.col(f"cum_{c}") - F.col(c) for c in lanes]).alias("up"))


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, conv_id) -> a hash per key, fed as the ids pass by; no group is held."""
    key, state = None, None
    for batch in batches:
        out: tuple[list, list] = ([], [])
        keys, ids = batch.column(0).to_pylist(), batch.column(1).cast(pa.string()).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            run = ",".join(ids[start:i]).encode()
            if keys[start] == key:
                state.update(b"," + run)
            else:
                if key is not None:
                    out[0].append(key)
                    out[1].append(state.hexdigest())
                key, state = keys[start], hashlib.sha256(run)
            start = i
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], ["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])


def _added(value: str, more: str) -> Column:
    return (F.col(value) + F.coalesce(F.col(more), F.lit(0))).alias(value)


def _xored(value: str, more: str) -> Column:
    return F.col(value).bitwiseXOR(F.coalesce(F.col(more), F.lit(0).cast("long"))).alias(value)


_LIVE = ["c", "d", "pc", "pd", "n", "xc", "xd", "leaves", "saved", "edge_leaves", "edge_saved"]


def _rake(live: DataFrame) -> DataFrame:
    """Live nodes without the leaves, whose totals went to their parents."""
    leaf = (F.col("n") == 0) & F.col("pc").isNotNull()
    given = live.where(leaf).groupBy(F.col("pc").alias("gc"), F.col("pd").alias("gd")).agg(
        (-F.count(F.lit(1))).alias("gn"), F.bit_xor("c").alias("gxc"), F.bit_xor("d").alias("gxd"),
        F.sum(F.col("leaves") + F.col("edge_leaves")).alias("g_leaves"),
        F.sum(F.col("saved") + F.col("edge_saved")).alias("g_saved"))
    met = live.where(~leaf).join(given, (F.col("c") == F.col("gc")) & (F.col("d") == F.col("gd")), "left")
    return met.select("c", "d", "pc", "pd", _added("n", "gn"), _xored("xc", "gxc"), _xored("xd", "gxd"),
                      _added("leaves", "g_leaves"), _added("saved", "g_saved"), "edge_leaves", "edge_saved")


def _compress(live: DataFrame, bit: int) -> DataFrame:
    """Live nodes without the unary ones whose turn it is; a row that moved up says what it passed in ``v*``."""
    turn = (F.col("n") == 1) & F.col("pc").isNotNull() & (F.shiftright("d", bit).bitwiseAND(F.lit(1)) == 1)
    above = live.where(turn).select(F.col("xc").alias("bc"), F.col("xd").alias("bd"), F.lit(True).alias("below"))
    live = live.join(above, (F.col("c") == F.col("bc")) & (F.col("d") == F.col("bd")), "left").drop("bc", "bd")
    goes = F.coalesce(turn, F.lit(False)) & F.col("below").isNull()
    gone, stay = live.where(goes), live.where(~goes)
    none = F.lit(None).cast("long")
    to_child = gone.select(F.col("xc").alias("mc"), F.col("xd").alias("md"), none.alias("mxc"), none.alias("mxd"),
                           F.struct("c", "d", "pc", "pd", "leaves", "saved", "edge_leaves", "edge_saved").alias("v"))
    to_parent = gone.select(F.col("pc").alias("mc"), F.col("pd").alias("md"), F.col("c").bitwiseXOR(F.col("xc")).alias("mxc"),
                            F.col("d").bitwiseXOR(F.col("xd")).alias("mxd"), F.lit(None).cast(to_child.schema["v"].dataType).alias("v"))
    told = to_child.unionByName(to_parent).groupBy("mc", "md").agg(
        F.bit_xor("mxc").alias("mxc"), F.bit_xor("mxd").alias("mxd"), F.max("v").alias("v"))
    met = stay.join(told, (F.col("c") == F.col("mc")) & (F.col("d") == F.col("md")), "left")
    moved = F.col("v").isNotNull()
    return met.select(
        "c", "d", F.when(moved, F.col("v.pc")).otherwise(F.col("pc")).alias("pc"), F.when(moved, F.col("v.pd")).otherwise(F.col("pd")).alias("pd"),
        "n", _xored("xc", "mxc"), _xored("xd", "mxd"), "leaves", "saved",
        *[(F.col(f"edge_{x}") + F.when(moved, F.col(f"v.{x}") + F.col(f"v.edge_{x}")).otherwise(0)).alias(f"edge_{x}") for x in ("leaves", "saved")],
        F.col("v.c").alias("vc"), F.col("v.d").alias("vd"),
        *[(F.col(f"v.{x}") + F.col(f"edge_{x}")).alias(f"v_{x}") for x in ("leaves", "saved")])


def subtree_totals(tree: DataFrame, deepest: int) -> DataFrame:
    """(c, d, pc, pd, n, xc, xd, leaves, saved) of each node -> (c, d, leaves, saved) of its whole subtree."""
    live = tree.withColumns({"edge_leaves": F.lit(0).cast("long"), "edge_saved": F.lit(0).cast("long")}).select(*_LIVE)
    bits, turn, known, linked = max(1, int(deepest).bit_length()), 0, [], []
    totals = ["c", "d", "leaves", "saved"]
    while live.where("pc IS NOT NULL").limit(1).count():
        known.append(live.where("n = 0 AND pc IS NOT NULL").select(*totals))
        raked = scratch(_rake(live), "trie-raked")
        passed = scratch(_compress(raked, turn % bits), "trie-live")
        linked.append(passed.where("vc IS NOT NULL").select(
            F.col("vc").alias("c"), F.col("vd").alias("d"), F.col("v_leaves").alias("leaves"), F.col("v_saved").alias("saved"),
            F.col("c").alias("nc"), F.col("d").alias("nd")))
        drop_scratch(raked)
        live, turn = passed.select(*_LIVE), turn + 1
    known.append(live.select(*totals))
    return _expand(known, linked)


def _expand(known: list[DataFrame], linked: list[DataFrame]) -> DataFrame:
    """Totals of compressed nodes: each link is replaced by the link of its target until it ends at a known total."""
    done = known[0]
    for k in known[1:]:
        done = done.unionByName(k)
    done = scratch(done, "trie-known")
    none = F.lit(None).cast("long")
    parts, waiting = [done], None
    for more in linked:
        waiting = more if waiting is None else waiting.unionByName(more)
    waiting = None if waiting is None else scratch(waiting, "trie-links")
    while waiting is not None and waiting.limit(1).count():
        there = waiting
        for p in parts:
            there = there.unionByName(p.withColumns({"nc": none, "nd": none}))
        there = there.select(*[F.col(c).alias(f"t_{c}") for c in there.columns])
        jumped = waiting.join(there, (F.col("nc") == F.col("t_c")) & (F.col("nd") == F.col("t_d"))).select(
            "c", "d", (F.col("leaves") + F.col("t_leaves")).alias("leaves"), (F.col("saved") + F.col("t_saved")).alias("saved"),
            F.col("t_nc").alias("nc"), F.col("t_nd").alias("nd"))
        jumped = scratch(jumped, "trie-jumped")
        parts.append(jumped.where("nc IS NULL").drop("nc", "nd"))
        waiting = jumped.where("nc IS NOT NULL")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations, with its subtree's totals."""
    turns = scratch(ordered_turns(conversations), "trie-turns")
    convs, rebuilt = spliced_conversations(turns)
    members = scratch(prefixes(rebuilt), "trie-members")
    drop_scratch(turns)

    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(_ROOT_KEY).alias("key"), F.lit(None).cast("string").alias("up"), "conv_id",
                       F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("chars"))
    nodes = members.groupBy("key").agg(
        F.max("up").alias("up"), F.min("conv_id").alias("conv_id"), F.max("pos").cast("long").alias("depth"),
        F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"))
    nodes = scratch(nodes.unionByName(root), "trie-nodes")
    below = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(
        F.count(F.lit(1)).alias("n_children"), F.bit_xor("conv_id").alias("xc"), F.bit_xor("depth").alias("xd"))
    zero = F.lit(0).cast("long")
    nodes = scratch(nodes.join(below, "key", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("n_children", "xc", "xd")}), "trie-children")
    size = nodes.agg(F.count(F.lit(1)), F.max("depth")).first()
    parents = nodes.where("n_children > 0").select(
        F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n_below"))
    tree = scratch(attach(nodes, parents, "up", "n_below", size[0]).withColumn(
        "own_saved", (F.col("n_convs") - 1) * F.col("chars")), "trie-tree")
    totals = subtree_totals(tree.select(
        F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("parent_conv_id").alias("pc"),
        F.when(F.col("up").isNotNull(), F.col("depth") - 1).alias("pd"), F.col("n_children").alias("n"), "xc", "xd",
        (F.col("n_children") == 0).cast("long").alias("leaves"), F.col("own_saved").alias("saved")), size[1] or 0)

    last = members.groupBy("conv_id").agg(F.max(F.struct("pos", "key")).alias("m")).select(F.col("m.key").alias("key"), "conv_id")
    last = last.unionByName(convs.where("length = 0").select(F.lit(_ROOT_KEY).alias("key"), "conv_id"))
    ends = last.repartition("key").sortWithinPartitions("key", "conv_id") \
        .mapInArrow(_hash_ends, "key string, ends_sha256 string")
    return tree.join(totals, (F.col("conv_id") == F.col("c")) & (F.col("depth") == F.col("d"))).join(ends, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256"))
