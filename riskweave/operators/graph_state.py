"""GR1-GR4 of arriving rows against all rows before them, without rebuilding the graph.

The state of a history has three tables, each of rows that merge by sums or minima:

* hubs (hub, size, members, component): how many rows hold the hub's key values (GR2), and for hubs
  that link, the component of those rows under the name it had when they came;
* sizes (component, rows): rows that came into a component under that name;
* moved (component, now): names that went out of use, because a batch linked two components. A
  component is named by its smallest id, so names only fall and the least ``now`` is the valid one.

A batch touches the hubs its rows hold. Its new links join rows that share a hub
and the components that its hubs belong to; the connected components of these few links give the new
names. Everything beyond the touched components stays as it is. Degrees need the
members of the batch's own hubs only (inclusion and exclusion, see ``graph``).

The batch's side of every join with the state is small (rows of one batch) and broadcast behind
a measured bound, so the state is scanned but not shuffled; a large batch takes ordinary joins.
Rows are told apart by id: a batch must not repeat ids or use those of earlier rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .graph import DEFAULT_LINK_KEYS, MIN_LINK_KEYS, components, hub_rows
from .joins import sized_broadcast

HUBS_SCHEMA = "hub string, size int, members long, component long"
SIZES_SCHEMA = "component long, rows long"
MOVED_SCHEMA = "component long, now long"
MAX_BROADCAST_ROWS = 200_000


def merge_hubs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hub", "size").agg(F.sum("members").alias("members"), F.min("component").alias("component"))


def merge_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("component").agg(F.sum("rows").alias("rows"))


def merge_moved(rows: DataFrame) -> DataFrame:
    return rows.groupBy("component").agg(F.min("now").alias("now"))


@dataclass
class GraphState:
    """Merged or unmerged rows of the three tables (``before`` of an epoch table gives merged ones)."""
    hubs: DataFrame
    sizes: DataFrame
    moved: DataFrame


@dataclass
class GraphUpdate:
    features: DataFrame     # id, graph_component_size, graph_degree, graph_isolated of the batch's rows
    hubs: DataFrame         # rows that the batch adds to the state's tables
    sizes: DataFrame
    moved: DataFrame


def empty_state(spark) -> GraphState:
    return GraphState(*[spark.createDataFrame([], s) for s in (HUBS_SCHEMA, SIZES_SCHEMA, MOVED_SCHEMA)])


def merged(state: GraphState, update: GraphUpdate) -> GraphState:
    """The state after the batch, for callers that keep it in memory or in tables of their own."""
    return GraphState(merge_hubs(state.hubs.unionByName(update.hubs)), merge_sizes(state.sizes.unionByName(update.sizes)),
                      merge_moved(state.moved.unionByName(update.moved)))


def _named(component: str, valid: str) -> Column:
    return F.least(F.col(component), F.coalesce(F.col(valid), F.col(component)))


def link_batch(batch: DataFrame, state: GraphState, keys: Sequence[str] = DEFAULT_LINK_KEYS,
               min_link_keys: int = MIN_LINK_KEYS, id_col: str = "id") -> GraphUpdate:
    """Features of the batch's rows in the graph of all rows so far, and what the batch adds to the state."""
    m, k = min_link_keys, len(keys)
    # the keys are written once and the hubs derived from them when read: a hub repeats the values of its keys
    keyed = materialise(batch.select(F.col(id_col).alias("id"), *[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(keys)]), "batch-keys")
    mine = hub_rows(keyed, [f"k{i}" for i in range(k)], range(m, k + 1))
    here = mine.groupBy("hub", "size").agg(F.count(F.lit(1)).alias("new"), F.min("id").alias("first"))
    here = materialise(here, "batch-hub-counts")

    asked = sized_broadcast(here.select("hub"), MAX_BROADCAST_ROWS)
    old = merge_hubs(state.hubs.join(asked, "hub", "left_semi"))
    names = sized_broadcast(old.where("component IS NOT NULL").select("component").distinct(), MAX_BROADCAST_ROWS)
    valid = merge_moved(state.moved.join(names, "component", "left_semi")).withColumnRenamed("now", "valid")
    old = old.join(valid, "component", "left").select("hub", "members", _named("component", "valid").alias("component"))
    here = materialise(here.join(old, "hub", "left").withColumn("members", F.coalesce("members", F.lit(0).cast("long"))),
                       "batch-hubs-known")

    linking = F.col("size") == m
    star = mine.where(linking).join(here.where(linking).select("hub", "first"), "hub") \
        .where(F.col("id") != F.col("first")).select(F.col("first").alias("src"), F.col("id").alias("dst"))
    known = here.where(linking & F.col("component").isNotNull()).select(F.col("first").alias("src"), F.col("component").alias("dst"))
    label = materialise(components(star.unionByName(known).distinct()), "batch-components")   # node, component
    ids = batch.select(F.col(id_col).alias("id"))
    now = ids.join(label.withColumnRenamed("node", "id"), "id", "left") \
        .select("id", F.coalesce("component", F.col("id")).alias("component"))
    now = materialise(now, "batch-labels")

    # touched components: their old names, and all names that led to those
    touched = materialise(known.select(F.col("dst").alias("node")).distinct().join(label, "node")
                          .select(F.col("node").alias("was"), F.col("component").alias("now")), "batch-touched")
    ends = sized_broadcast(touched, MAX_BROADCAST_ROWS)
    aliases = materialise(merge_moved(state.moved).withColumnRenamed("now", "was").join(ends, "was")
                          .select("component", "was", "now").unionByName(touched.select(F.col("was").alias("component"), "was", "now")), "batch-aliases")
    before = state.sizes.join(sized_broadcast(aliases.select("component", "now"), MAX_BROADCAST_ROWS), "component").groupBy(F.col("now").alias("component")) \
        .agg(F.sum("rows").alias("old_rows"))
    added = now.groupBy("component").agg(F.count(F.lit(1)).alias("rows"))
    size = added.join(before, "component", "left").select("component", (F.col("rows") + F.coalesce("old_rows", F.lit(0))).alias("size"))

    sign = F.lit(0)
    for j in range(m, k + 1):
        sign = F.when(F.col("size") == j, F.lit((-1) ** (j - m) * comb(j - 1, m - 1))).otherwise(sign)
    degree = mine.join(here.select("hub", (F.col("members") + F.col("new")).alias("held")), "hub") \
        .groupBy("id").agg((F.sum(sign * F.col("held")) - 1).cast("long").alias("degree"))
    graph_degree = F.coalesce("degree", F.lit(0).cast("long"))
    features = now.join(size, "component").join(degree, "id", "left").select(
        F.col("id").alias(id_col), F.col("size").cast("int").alias("graph_component_size"),
        graph_degree.alias("graph_degree"), (graph_degree == 0).cast("int").alias("graph_isolated"))

    owner = now.select(F.col("id").alias("first"), F.col("component").alias("owner"))
    return GraphUpdate(
        materialise(features, "batch-graph"),
        here.select("hub", "size", "new", "first").join(owner, "first").select(
            "hub", "size", F.col("new").alias("members"), F.when(F.col("size") == m, F.col("owner")).alias("component")),
        added.select("component", "rows"),
        aliases.where(F.col("was") != F.col("now")).select("component", "now"))


def graph_features_with_history(batch: DataFrame, state: GraphState, keys: Sequence[str] = DEFAULT_LINK_KEYS,
                                min_link_keys: int = MIN_LINK_KEYS, id_col: str = "id") -> DataFrame:
    """The batch with its graph features in the graph of the history and itself."""
    update = link_batch(batch, state, keys, min_link_keys, id_col)
    return batch.join(update.features, id_col)
