"""GR1-GR5: shared-attribute linkage graph and its component features.

Two rows are linked when they share at least ``min_link_keys`` non-null link
keys. The pairs of a block grow with the square of its size, so they are never
listed; what the features need comes from counts and from a linkage table of linear size:

GR1 blocking: per link key, values held by at least two rows (NULL never
links). Block sizes come from a partial aggregation; there is no upper limit.

GR2 linkage: every ``min_link_keys``-subset of keys and its values form a hub;
a row belongs to the hubs of the values it has. Two rows are linked exactly
when they share a hub. ``links_of`` lists the partners of asked ids only.

GR3 components: every member of a hub is linked to the hub's smallest id (a
star instead of all pairs). Each round contracts the links (see ``components``), so later
rounds work on ever fewer of them; the loop ends when none is left. Rounds are written to the shared folder.

GR4 degree: the number of rows that share at least m of K keys follows by
inclusion and exclusion from the block sizes of the key subsets of m keys and more.
Component sizes are the true sizes.

GR5: nodes, edges (half the sum of the degrees), components, largest component.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb
from operator import and_
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialise

# Defaults of the graph builder.
DEFAULT_LINK_KEYS = ("zip_code", "emp_title", "income_bucket")
MIN_LINK_KEYS = 2


def _keyed(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), *[F.col(k).cast("string").alias(f"key{i}") for i, k in enumerate(keys)])


def blocked_keys(df: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """GR1: (id, key_0 .. key_k) with each key NULL unless at least two rows hold its value."""
    out = _keyed(df, keys, id_col)
    for i in range(len(keys)):
        c = f"key{i}"
        shared = (_keyed(df, keys, id_col).where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"_ok{i}"))
                  .agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select(f"_ok{i}"))
        out = out.join(shared, F.col(c) == F.col(f"_ok{i}"), "left").withColumn(c, F.col(f"_ok{i}")).drop(f"_ok{i}")
    return out


def _hubs(keyed: DataFrame, n_keys: int, sizes: Sequence[int]) -> DataFrame:
    """(id, size, hub): one row per row and key subset of a wanted size whose keys are all present.

    ``hub`` is the subset's number and its values; values are length-prefixed, so no two lists collide.
    """
    subsets = [s for m in sizes for s in combinations(range(n_keys), m)]

    def hub(j: int, s: tuple[int, ...]) -> Column:
        values = [F.concat(F.char_length(f"key{i}").cast("string"), F.lit(":"), F.col(f"key{i}")) for i in s]
        return F.concat(F.lit(f"{j}|"), *values)      # NULL when any key is

    entries = F.array(*[F.struct(F.lit(len(s)).alias("size"), hub(j, s).alias("hub")) for j, s in enumerate(subsets)])
    return keyed.select("id", F.explode(entries).alias("e")).select("id", "e.size", "e.hub").where("hub IS NOT NULL")


def hub_rows(df: DataFrame, keys: Sequence[str], sizes: Sequence[int], id_col: str = "id") -> DataFrame:
    """(id, size, hub) of every row and key subset of the given sizes; rows without all keys of a subset are not in it."""
    return _hubs(_keyed(df, keys, id_col), len(keys), sizes)


def linkage(df: DataFrame, keys: Sequence[str], min_link_keys: int = MIN_LINK_KEYS, id_col: str = "id") -> DataFrame:
    """GR2: (id, link_keys, hub, members): the hubs of two members and more that a row belongs to."""
    hubs = _hubs(_keyed(df, keys, id_col), len(keys), [min_link_keys])
    members = hubs.groupBy("hub").agg(F.count(F.lit(1)).alias("members")).where("members >= 2")
    names = ["+".join(keys[i] for i in s) for s in combinations(range(len(keys)), min_link_keys)]
    number = F.substring_index("hub", "|", 1).cast("int")
    return hubs.join(members, "hub").select("id", F.get(F.array(*[F.lit(n) for n in names]), number).alias("link_keys"),
                                            "hub", "members")


def links_of(df: DataFrame, asked: DataFrame, keys: Sequence[str], min_link_keys: int = MIN_LINK_KEYS,
             id_col: str = "id") -> DataFrame:
    """All partners of the asked ids: (id, partner, weight), weight the number of shared keys.

    One join per key subset of ``min_link_keys`` keys, both sides carrying all keys. A pair that shares several subsets
    comes from the first of them only, so the pairs, which grow with the square of a block, are never shuffled."""
    keyed = _keyed(df, keys, id_col)
    every = range(len(keys))
    mine = keyed.join(asked.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi") \
        .select("id", *[F.col(f"key{i}").alias(f"a{i}") for i in every])
    others = keyed.select(F.col("id").alias("partner"), *[F.col(f"key{i}").alias(f"b{i}") for i in every])
    same = [F.coalesce(F.col(f"a{i}") == F.col(f"b{i}"), F.lit(False)) for i in every]
    weight = sum((x.cast("int") for x in same), F.lit(0))
    pairs, earlier = [], F.lit(False)
    for s in combinations(every, min_link_keys):
        shared = reduce(and_, [F.col(f"a{i}") == F.col(f"b{i}") for i in s])
        pairs.append(mine.join(others, shared & (F.col("id") != F.col("partner")) & ~earlier).select("id", "partner", weight.alias("weight")))
        earlier = earlier | reduce(and_, [same[i] for i in s])
    return reduce(DataFrame.unionByName, pairs)


def hub_table(df: DataFrame, keys: Sequence[str], min_link_keys: int = MIN_LINK_KEYS, id_col: str = "id") -> DataFrame:
    """(id, size, n, first): the shared hubs of every row (of ``min_link_keys`` keys and more) with the
    hub's rows and smallest id. One aggregation by hub; components and degrees both read it."""
    hubs = hub_rows(df, keys, range(min_link_keys, len(keys) + 1), id_col)
    shared = hubs.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n >= 2")
    return hubs.join(shared, "hub").select("id", "size", "n", "first")


def _stars(hubs: DataFrame, min_link_keys: int) -> DataFrame:
    return hubs.where((F.col("size") == min_link_keys) & (F.col("id") != F.col("first"))) \
        .select(F.col("first").alias("src"), F.col("id").alias("dst")).distinct()


def star_links(df: DataFrame, keys: Sequence[str], min_link_keys: int = MIN_LINK_KEYS, id_col: str = "id") -> DataFrame:
    """(src, dst): every hub member linked to the hub's smallest id; same components as all pairs, linear size."""
    return _stars(hub_table(df, keys, min_link_keys, id_col), min_link_keys)


def components(links: DataFrame) -> DataFrame:
    """GR3: (node, component): the smallest id of the node's component, for every node that has a link.

    Each round a node takes the smallest id among itself and its neighbours, then what that one took, until nothing
    changes (pointer jumping, each step doubles the reach); then every link is drawn between the taken
    ids, and links inside one id and repeated links go. Taken ids are smaller than all their neighbours: such a node has either
    taken over all its neighbours or gets a smaller neighbour, so two rounds at least halve the
    nodes and the links shrink from round to round. At the end the takings are followed from the last round back.
    """
    between = F.col("src") != F.col("dst")
    edges = materialise(links.select("src", "dst").where(between).distinct(), "graph-links")
    taken, steps = [], 0
    while not taken or edges.limit(1).count():
        both = edges.toDF("node", "peer").unionByName(edges.toDF("peer", "node"))
        label = materialise(both.groupBy("node").agg(F.least(F.min("peer"), F.col("node")).alias("label")), "graph-labels")
        moved = True
        while moved:
            steps += 1
            there = label.select(F.col("node").alias("label"), F.col("label").alias("_there"))
            jumped = materialise(label.join(there, "label").select("node", F.col("_there").alias("label"), (F.col("_there") != F.col("label")).alias("moved")), "graph-labels")
            moved = jumped.where("moved").limit(1).count() > 0
            discard(label)
            label = jumped
        taken.append(label.drop("moved"))
        taken[-1]._scratch_path = label._scratch_path
        a, b = (label.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in ("src", "dst"))
        drawn = edges.join(a, "src").join(b, "dst").select(F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst"))
        shorter = materialise(drawn.where(between).distinct(), "graph-links")
        discard(edges)
        edges = shorter
    discard(edges)
    components.rounds = steps   # exposed for tests and tuning
    found = taken.pop()
    while taken:
        label, later = taken.pop(), found.select(F.col("node").alias("label"), F.col("label").alias("_later"))
        merged = materialise(label.join(later, "label", "left").select("node", F.coalesce("_later", "label").alias("label")), "graph-labels")
        discard(label)
        discard(found)
        found = merged
    return found.select("node", F.col("label").alias("component"))


def _degrees(hubs: DataFrame, k: int, m: int) -> DataFrame:
    sign = F.lit(0)
    for j in range(m, k + 1):
        sign = F.when(F.col("size") == j, F.lit((-1) ** (j - m) * comb(j - 1, m - 1))).otherwise(sign)
    return hubs.groupBy("id").agg(F.sum(sign * (F.col("n") - 1)).cast("long").alias("degree"))


def degrees(df: DataFrame, keys: Sequence[str], min_link_keys: int = MIN_LINK_KEYS, id_col: str = "id") -> DataFrame:
    """(id, degree): rows that share at least ``min_link_keys`` keys with the row, itself excluded (rows without any are left out).

    With S_j the other rows of a row's j-key hubs added up, the rows that agree on
    at least m keys number sum over j >= m of (-1)^(j-m) C(j-1, m-1) S_j.
    """
    return _degrees(hub_table(df, keys, min_link_keys, id_col), len(keys), min_link_keys)


def graph_features(df: DataFrame, link_keys: Sequence[str] = DEFAULT_LINK_KEYS, min_link_keys: int = MIN_LINK_KEYS,
                   id_col: str = "id") -> DataFrame:
    """GR1-GR4: the frame with graph_component_size, graph_degree, graph_isolated. Missing link keys are skipped."""
    keys = [k for k in link_keys if k in df.columns]
    if len(keys) < min_link_keys:
        return df.select("*", F.lit(1).alias("graph_component_size"), F.lit(0).cast("long").alias("graph_degree"),
                         F.lit(1).alias("graph_isolated"))
    hubs = materialise(hub_table(df.select(id_col, *keys), keys, min_link_keys, id_col), "graph-hubs")
    comp = components(_stars(hubs, min_link_keys))
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("_size"))
    comp_size = comp.join(sizes, "component").select(F.col("node").alias("_node"), "_size")
    deg = _degrees(hubs, len(keys), min_link_keys).select(F.col("id").alias("_id"), F.col("degree").alias("_degree"))
    # both sides by id: one narrow table, so the wide frame is joined once
    found = materialise(comp_size.join(deg, F.col("_node") == F.col("_id")).select(F.col("_id").alias(id_col), "_size", "_degree"), "graph-found")
    discard(hubs)
    degree = F.coalesce(F.col("_degree"), F.lit(0).cast("long"))
    return (df.join(found, id_col, "left")
            .withColumns({"graph_component_size": F.coalesce(F.col("_size").cast("int"), F.lit(1)),
                          "graph_degree": degree, "graph_isolated": (degree == 0).cast("int")})
            .drop("_size", "_degree"))


def build_graph_features(df: DataFrame, **kw) -> DataFrame:
    return graph_features(df, **kw)


def graph_summary(df: DataFrame, keys: Sequence[str], min_link_keys: int = MIN_LINK_KEYS, id_col: str = "id") -> DataFrame:
    """GR5: n_nodes, n_edges, n_components (isolated rows included), largest_component."""
    hubs = materialise(hub_table(df.select(id_col, *keys), keys, min_link_keys, id_col), "graph-hubs")
    comp = components(_stars(hubs, min_link_keys))
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    c = sizes.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("linked"),
                  F.coalesce(F.max("size"), F.lit(1)).alias("largest")).first()
    edges = _degrees(hubs, len(keys), min_link_keys).agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("d")).first()["d"]
    discard(hubs)
    n = df.count()
    return df.sparkSession.createDataFrame(
        [(n, edges // 2, n - c["linked"] + c["groups"], int(c["largest"]))],
        "n_nodes long, n_edges long, n_components long, largest_component long")
