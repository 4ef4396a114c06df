"""Registered queries: splits (P1-P5, G1) and velocity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import ordering as G
from ...operators import split as P
from ...operators import velocity as W
from ...operators import velocity_index as VI
from ...sources.applications import applications
from ...sources.io import scratch_path
from ...sources.scratch import materialise
from ...sources.tables import table
from ...streaming import scoring as ST
from ..registry import register, rounded, with_apps
from .labels import LABELLED_CTES, labelled

_P1_SQL = """
, o AS (SELECT id, issue_d, row_number() OVER (ORDER BY issue_d NULLS LAST, id) - 1 AS pos,
               count(*) OVER () AS n FROM applications),
s AS (SELECT id, issue_d, CASE WHEN pos >= CAST(floor(n * (1e0 - 15e-2)) AS BIGINT) THEN 'test'
                         WHEN pos >= CAST(floor(n * (1e0 - 15e-2 - 15e-2)) AS BIGINT) THEN 'val'
                         ELSE 'train' END AS split FROM o)
"""


@register("P1_time_split", with_apps(_P1_SQL + "SELECT id, split FROM s"))
def p1(spark, sf):
    return P.time_split(applications(spark, sf)).select("id", "split")


@register("P2_split_spans", with_apps(_P1_SQL + """
SELECT split, count(*) AS n, min(issue_d) AS min_date, max(issue_d) AS max_date FROM s GROUP BY split"""))
def p2(spark, sf):
    return P.split_spans(P.time_split(applications(spark, sf)))


@register("G1_global_index", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS gidx FROM orders""")
def g1(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return G.indexed(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "gidx")


_SHUFFLED = LABELLED_CTES + """
, sh AS (SELECT id, is_fraud, row_number() OVER (PARTITION BY is_fraud ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) - 1 AS pos,
                count(*) OVER (PARTITION BY is_fraud) AS n FROM labelled)
"""


@register("P3_stratified_split", with_apps(_SHUFFLED + """
, b AS (SELECT id, is_fraud, CASE WHEN pos < ceil(n * 15e-2) THEN 'test' WHEN pos < ceil(n * (15e-2 + 85e-2 * (15e-2 / 85e-2)))
          THEN 'val' ELSE 'train' END AS split FROM sh)
SELECT id, is_fraud, split FROM b"""))
def p3(spark, sf):
    """Every row with its split; class shares are kept."""
    s = P.stratified_split(materialise(labelled(spark, sf, "id").select("id", "is_fraud"), "split-input"), "is_fraud")
    return s.select("id", "is_fraud", "split")


@register("P4_stratified_folds", with_apps(_SHUFFLED + """
SELECT id, is_fraud, CAST((CASE WHEN pos >= ceil(n * (1e0 / 3)) THEN 1 ELSE 0 END)
                          + (CASE WHEN pos >= ceil(n * (2e0 / 3)) THEN 1 ELSE 0 END) AS INTEGER) AS fold FROM sh"""))
def p4(spark, sf):
    s = P.stratified_folds(materialise(labelled(spark, sf, "id").select("id", "is_fraud"), "fold-input"), k=3)
    return s.select("id", "is_fraud", "fold")


_P5_KEEP = ("id", "issue_d", "earliest_cr_line", "loan_amnt", "annual_inc", "dti", "term", "int_rate", "revol_util",
            "revol_bal", "emp_length", "grade", "home_ownership", "purpose", "addr_state", "emp_title", "title",
            "zip_code", "open_acc", "total_acc", "delinq_2yrs", "pub_rec", "score")


@register("P5_leakage_guard", with_apps(LABELLED_CTES + f"SELECT {', '.join(_P5_KEEP)} FROM labelled"))
def p5(spark, sf):
    return rounded(P.drop_leakage(labelled(spark, sf)))


# ---------------------------------------------------------------- W1-W2

_KEYS = W.DEFAULT_KEYS
_WINS = W.DEFAULT_WINDOWS


def _vel_sql(source: str, id_col: str, key: str, time_expr: str, scale: int, peers: bool, prefix: str) -> str:
    cond = "b.t <= a.t AND b.id <> a.id" if peers else "(b.t < a.t OR (b.t = a.t AND b.id < a.id))"
    cols = ", ".join(
        f"CAST(count(b.id) FILTER (WHERE b.t >= a.t - {w * scale}) AS INTEGER) AS {prefix}_{key}_{w}d" for w in _WINS)
    return f"""
  SELECT a.id, {cols}
  FROM (SELECT {id_col} AS id, CAST({key} AS VARCHAR) AS kv, {time_expr} AS t FROM {source}) a
  LEFT JOIN (SELECT {id_col} AS id, CAST({key} AS VARCHAR) AS kv, {time_expr} AS t FROM {source}) b
    ON a.kv = b.kv AND b.t >= a.t - {max(_WINS) * scale} AND {cond}
  GROUP BY a.id"""


_DAY = "(CAST(issue_d AS DATE) - DATE '1970-01-01')"
_DAYQ = "(CAST(applications.issue_d AS DATE) - DATE '1970-01-01')"


def _vel_all_sql(peers: bool) -> str:
    prefix = "velp" if peers else "vel"
    parts = [f"k{i} AS ({_vel_sql('applications', 'id', k, _DAY, 1, peers, prefix)})" for i, k in enumerate(_KEYS)]
    cols = ", ".join(f"{prefix}_{k}_{w}d" for k in _KEYS for w in _WINS)
    return with_apps(", " + ",\n".join(parts) + f"""
SELECT id, {cols} FROM k0 JOIN k1 USING (id) JOIN k2 USING (id)""")


def _vel_cols(prefix):
    return [f"{prefix}_{k}_{w}d" for k in _KEYS for w in _WINS]


def _velocity_input(spark, sf):
    return materialise(applications(spark, sf).select("id", "issue_d", *_KEYS), "velocity-input")


@register("W1_velocity", _vel_all_sql(False))
def w1(spark, sf):
    return W.build_velocity_features(_velocity_input(spark, sf)).select("id", *_vel_cols("vel"))


@register("W2_velocity_peers", _vel_all_sql(True))
def w2(spark, sf):
    return W.build_velocity_peers(_velocity_input(spark, sf)).select("id", *_vel_cols("velp"))


_EV_T = "epoch_us(ts)"


@register("W1_velocity_events", "WITH x AS (" + _vel_sql("events", "event_id", "user_id", _EV_T, 86_400_000_000,
                                                         False, "vel") + ") SELECT id AS event_id, "
          + ", ".join(f"vel_user_id_{w}d" for w in _WINS) + " FROM x")
def w1_events(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts")
    out = W.build_velocity_features(ev, "ts", ["user_id"], _WINS, id_col="event_id", unit="micros")
    return out.select("event_id", *[f"vel_user_id_{w}d" for w in _WINS])


def _vel_hist_sql() -> str:
    parts = []
    for i, k in enumerate(_KEYS):
        cols = ", ".join(
            f"CAST(count(b.id) FILTER (WHERE b.t >= a.t - {w} AND (b.hist OR b.t < a.t OR (b.t = a.t AND b.id < a.id)))"
            f" AS INTEGER) AS vel_{k}_{w}d" for w in _WINS)
        parts.append(f"""k{i} AS (
  SELECT a.id, {cols}
  FROM (SELECT id, CAST({k} AS VARCHAR) AS kv, {_DAYQ} AS t FROM applications JOIN s USING (id)
        WHERE s.split = 'test') a
  LEFT JOIN (SELECT id, CAST({k} AS VARCHAR) AS kv, {_DAYQ} AS t, s.split <> 'test' AS hist
             FROM applications JOIN s USING (id)) b
    ON a.kv = b.kv AND b.t >= a.t - {max(_WINS)} AND b.t <= a.t AND b.id <> a.id
  GROUP BY a.id)""")
    cols = ", ".join(f"vel_{k}_{w}d" for k in _KEYS for w in _WINS)
    return with_apps(_P1_SQL + ", " + ",\n".join(parts) + f"""
SELECT id, {cols} FROM k0 JOIN k1 USING (id) JOIN k2 USING (id)""")


@register("W1_velocity_with_history", _vel_hist_sql())
def w1_history(spark, sf):
    """Test-period rows scored against a stored snapshot of the train/val history (S2/S3 path)."""
    s = P.time_split(_velocity_input(spark, sf))
    state = materialise(W.velocity_state(s.where(F.col("split") != "test")), "velocity-state")
    batch = s.where(F.col("split") == "test")
    return W.build_velocity_with_history(batch, state).select("id", *_vel_cols("vel"))


@register("S3_W1_stream_state", _vel_all_sql(False))
def s3_velocity(spark, sf):
    """Velocity of a stream that is stopped and started between four deliveries in (day, id) order and keeps its counts;
    the twin counts over all rows at once."""
    ranked = G.indexed(_velocity_input(spark, sf), ["issue_d", "id"], "_at")
    ranked = materialise(ranked, "stream-order")
    n = ranked.count()
    src, sink, state, progress = (scratch_path(spark, f"velocity-stream-{x}") for x in ("source", "sink", "state", "progress"))
    for i in range(4):
        part = ranked.where((F.col("_at") >= n * i // 4) & (F.col("_at") < n * (i + 1) // 4)).drop("_at")
        part.write.mode("append").parquet(src)
        ST.velocity_stream(spark, src, part.schema, sink, state, progress, compact_every=2)
    return spark.read.parquet(sink).drop("epoch")


def _events_history_sql() -> str:
    cols = ", ".join(
        f"CAST(count(b.event_id) FILTER (WHERE b.t >= a.t - {w * 86_400_000_000} AND (b.hist OR b.t < a.t OR (b.t = a.t AND b.event_id < a.event_id)))"
        f" AS INTEGER) AS vel_user_id_{w}d" for w in _WINS)
    return f"""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events),
c AS (SELECT min(t) + (max(t) - min(t)) // 10 * 7 AS cut FROM e),
x AS (SELECT e.*, t < cut AS hist FROM e, c)
SELECT a.event_id, {cols} FROM (SELECT * FROM x WHERE NOT hist) a
LEFT JOIN x b ON a.user_id = b.user_id AND b.t <= a.t AND b.t >= a.t - {max(_WINS) * 86_400_000_000} AND b.event_id <> a.event_id
GROUP BY a.event_id"""


@register("W1_velocity_events_with_history", _events_history_sql())
def w1_events_history(spark, sf):
    """The last three tenths of the time span against a saved index of the events before."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", W.time_value("ts", "micros").alias("at"))
    lo, hi = ev.agg(F.min("at"), F.max("at")).first()
    cut = lo + (hi - lo) // 10 * 7
    path = scratch_path(spark, "velocity-index")
    VI.build_index(ev.where(F.col("at") < cut), "ts", ["user_id"], "event_id").save(path)
    out = VI.build_velocity_with_index(ev.where(F.col("at") >= cut), VI.VelocityIndex.load(spark, path), "ts", ["user_id"], _WINS, "event_id")
    return out.select("event_id", *[f"vel_user_id_{w}d" for w in _WINS])
