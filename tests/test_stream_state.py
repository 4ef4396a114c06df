"""State kept between micro-batches: velocity counts, the linkage graph, quarantine, scratch."""

import os
import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators import graph as GR
from riskweave.operators import graph_state as GS
from riskweave.operators import velocity as W
from riskweave.session import ensure_checkpoint_dir
from riskweave.sources.scratch import materialise, scratch_scope
from riskweave.streaming import scoring as ST
from riskweave.streaming.state import EpochTable

KEYS = ["a", "b", "c"]


def links(rng, ids):
    return [(i, *(rng.choice([None, *range(k)]) for k in (4, 5, 6))) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, a int, b int, c int")


def by_id(df):
    return {r["id"]: (r["graph_component_size"], r["graph_degree"], r["graph_isolated"]) for r in df.collect()}


def test_batches_equal_the_whole_graph(spark):
    """Sparse keys make components that later batches join; some batches hold the smallest id of an older component."""
    rng = random.Random(1)
    ids = rng.sample(range(1000), 75)
    rows = [(i, rng.choice([None, *range(9)]), rng.choice([None, *range(9)]), rng.choice(range(9))) for i in ids]
    state, seen = GS.empty_state(spark), []
    for part in (rows[:25], rows[25:60], rows[60:]):
        batch = frame(spark, part)
        seen += part
        update = GS.link_batch(batch, state, KEYS)
        whole = by_id(GR.graph_features(frame(spark, seen), KEYS))
        assert by_id(update.features) == {i: whole[i] for i, *_ in part}
        state = GS.GraphState(*[materialise(t, "test-state") for t in vars(GS.merged(state, update)).values()])
    # names in use: every row counts in exactly one component
    named = state.sizes.join(state.moved, "component", "left").groupBy(F.coalesce("now", "component").alias("n")).agg(F.sum("rows").alias("r"))
    comp = GR.components(GR.star_links(frame(spark, rows), KEYS)).groupBy("component").count()
    sizes = sorted(r["r"] for r in named.collect())
    assert sizes == sorted([r["count"] for r in comp.collect()] + [1] * (75 - comp.agg(F.sum("count")).first()[0]))


def test_unmerged_and_unhinted_state_gives_the_same(spark, monkeypatch):
    rng = random.Random(4)
    old, new = links(rng, range(0, 60, 2)), links(rng, range(1, 60, 2))
    first = GS.link_batch(frame(spark, old), GS.empty_state(spark), KEYS)
    unmerged = GS.GraphState(first.hubs, first.sizes, first.moved)
    a = by_id(GS.graph_features_with_history(frame(spark, new), unmerged, KEYS))
    monkeypatch.setattr(GS, "MAX_BROADCAST_ROWS", 0)             # no side is small enough: ordinary joins
    b = by_id(GS.graph_features_with_history(frame(spark, new), unmerged, KEYS))
    whole = by_id(GR.graph_features(frame(spark, old + new), KEYS))
    assert a == b == {i: whole[i] for i, *_ in new}


def test_components_of_a_long_chain_and_a_late_smallest_id(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 0), (200, 500)], "src long, dst long")
    assert {r["component"] for r in GR.components(chain).collect()} == {0}
    assert GR.components.rounds <= 20
    assert GR.components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_epoch_table(spark, tmp_path):
    t = EpochTable(spark, str(tmp_path / "t"), "k string, n long", lambda d: d.groupBy("k").agg(F.sum("n").alias("n")), compact_every=3, sort_by=("k",))

    def rows(*kn):
        return spark.createDataFrame(list(kn), "k string, n long")

    def at(epoch):
        return {r["k"]: r["n"] for r in t.before(epoch).collect()}

    assert at(0) == {}
    t.put(0, rows(("a", 1), ("a", 2), ("b", 5)))
    t.put(1, rows(("a", 10)))
    t.put(1, rows(("a", 20)))                                    # run again: replaces its own rows
    assert at(0) == {} and at(1) == {"a": 3, "b": 5} and at(2) == {"a": 23, "b": 5}
    for e in range(2, 9):
        t.put(e, rows(("a", 100)))
    assert at(9) == {"a": 723, "b": 5}
    assert len(os.listdir(tmp_path / "t" / "base")) == 1 and len(os.listdir(tmp_path / "t" / "epoch")) <= 4
    os.remove(tmp_path / "t" / "epoch" / "8" / "_SUCCESS")       # cut short while writing
    assert at(9) == {"a": 623, "b": 5}


def velocity_rows(spark, ids):
    return spark.range(max(ids) + 1).where(F.col("id").isin(list(ids))).select(
        "id", F.expr("date_add(DATE'2024-01-01', CAST(id DIV 9 AS INT) * 5)").alias("issue_d"), (F.col("id") % 3).cast("string").alias("zip_code"))


def test_velocity_of_runs_and_a_killed_epoch_equal_one_batch(spark, tmp_path, monkeypatch):
    src, sink, state, progress = (str(tmp_path / x) for x in ("src", "sink", "state", "progress"))
    schema = velocity_rows(spark, [0]).schema

    def run():
        ST.velocity_stream(spark, src, schema, sink, state, progress, keys=["zip_code"], compact_every=2)

    def deliver(a, b):
        velocity_rows(spark, range(a, b)).coalesce(1).write.mode("append").parquet(src)

    deliver(0, 40)
    run()
    deliver(40, 80)
    put = EpochTable.put

    def dies_after_writing(self, epoch, rows):
        put(self, epoch, rows)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(EpochTable, "put", dies_after_writing)         # state written, micro-batch not finished
        with pytest.raises(Exception):
            run()
    run()                                                        # the same epoch again
    for a in range(80, 140, 20):
        deliver(a, a + 20)
        run()
    got = {r["id"]: tuple(r[c] for c in sorted(r.asDict()) if c.startswith("vel")) for r in spark.read.parquet(sink).collect()}
    whole = W.build_velocity_features(velocity_rows(spark, range(140)), keys=["zip_code"])
    assert got == {r["id"]: tuple(r[c] for c in sorted(r.asDict()) if c.startswith("vel")) for r in whole.collect()}


def test_graph_stream_equals_the_whole_graph(spark, tmp_path):
    src, sink, state, progress = (str(tmp_path / x) for x in ("src", "sink", "state", "progress"))
    rng = random.Random(8)
    rows = links(rng, rng.sample(range(500), 60))
    for i in range(0, 60, 20):
        frame(spark, rows[i:i + 20]).write.mode("append").parquet(src)
        ST.graph_stream(spark, src, "id long, a int, b int, c int", sink, state, progress, KEYS, compact_every=1)
    whole = by_id(GR.graph_features(frame(spark, rows), KEYS))
    got = by_id(spark.read.parquet(sink))
    assert len(got) == 60 and all(got[i] == whole[i] for i, *_ in rows[40:])


def test_scratch_of_a_stream_does_not_grow(spark, tmp_path):
    src, sink, state, progress = (str(tmp_path / x) for x in ("src", "sink", "state", "progress"))
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")

    def tables():
        return sum("-" in f and os.path.isdir(os.path.join(folder, f)) and f.split("-")[0] in ("velocity", "rank", "graph", "batch") for f in os.listdir(folder))

    before = tables()
    for e in range(3):
        velocity_rows(spark, range(e * 9, e * 9 + 9)).write.mode("append").parquet(src)
        ST.velocity_stream(spark, src, velocity_rows(spark, [0]).schema, sink, state, progress, keys=["zip_code"])
    assert tables() == before
    with scratch_scope():
        inner = materialise(spark.range(3), "graph-x")
        assert inner.count() == 3 and tables() == before + 1
    assert tables() == before
