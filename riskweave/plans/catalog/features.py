"""Registered queries: encoders (F1-F5), fitted numeric steps (F6-F8, F11), feature matrix (F9) and graph (GR1-GR5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import normalize as N
from ...functions.exprs import to_double
from ...operators import encode as E
from ...operators import graph as GR
from ...operators import graph_state as GS
from ...operators import split as P
from ...sources.applications import applications, raw_applications
from ...sources.io import scratch_path
from ...sources.scratch import materialise
from ...streaming import scoring as ST
from .. import features as FB
from ..registry import register, rounded, with_apps
from .labels import LABELLED_CTES, labelled
from .windows import _P1_SQL

_LOW = ["grade", "home_ownership", "purpose", "addr_state"]
_HIGH = ["emp_title", "zip_code"]


def _woe_sql(cols, src="labelled") -> str:
    tot = f"(SELECT sum(is_fraud) + 5e-1 AS b, count(*) - sum(is_fraud) + 5e-1 AS g FROM {src})"
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", coalesce(CAST({c} AS VARCHAR), '__NA__') AS value, is_fraud FROM {src}"
        for c in cols)
    return f"""
, lng AS ({parts}),
st AS (SELECT "column", value, count(*) AS n, sum(is_fraud) AS n_pos FROM lng GROUP BY "column", value),
wt AS (SELECT "column", value,
         ln(((n - n_pos + 5e-1) / t.g) / ((n_pos + 5e-1) / t.b)) AS woe,
         ((n - n_pos + 5e-1) / t.g - (n_pos + 5e-1) / t.b) * ln(((n - n_pos + 5e-1) / t.g) / ((n_pos + 5e-1) / t.b))
           AS iv_part
       FROM st, {tot} t)
"""


def _te_sql(cols, src="labelled") -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", coalesce(CAST({c} AS VARCHAR), '__NA__') AS value, is_fraud FROM {src}"
        for c in cols)
    return f"""
, tlng AS ({parts}),
gm AS (SELECT avg(is_fraud) AS m FROM {src}),
te AS (SELECT "column", value, (sum(is_fraud) + (SELECT m FROM gm) * 20e0) / (count(*) + 20e0) AS te
       FROM tlng GROUP BY "column", value)
"""


@register("F1_woe_fit", with_apps(LABELLED_CTES + _woe_sql(_LOW) + """
SELECT "column", value, round(woe, 6) AS woe FROM wt"""))
def f1(spark, sf):
    m = E.fit_woe(labelled(spark, sf), _LOW, "is_fraud")
    return rounded(m.table)


@register("F2_information_value", with_apps(LABELLED_CTES + _woe_sql(_LOW) + """
SELECT "column", round(sum(iv_part), 6) AS iv FROM wt GROUP BY "column" """))
def f2(spark, sf):
    return rounded(E.fit_woe(labelled(spark, sf), _LOW, "is_fraud").iv)


_TRAIN = """
, trn AS (SELECT l.* FROM labelled l JOIN s USING (id) WHERE s.split = 'train')
"""


@register("F3_woe_transform", with_apps(LABELLED_CTES + _P1_SQL + _TRAIN + _woe_sql(_LOW, "trn") + """
SELECT l.id, """ + ", ".join(
    f"round(coalesce((SELECT woe FROM wt WHERE \"column\" = '{c}' AND value = coalesce(CAST(l.{c} AS VARCHAR), "
    f"'__NA__')), 0e0), 6) AS {c}_woe" for c in _LOW) + " FROM labelled l"))
def f3(spark, sf):
    lab = materialise(labelled(spark, sf, "id", "issue_d", *_LOW).select("id", "issue_d", *_LOW, "is_fraud"), "woe-input")
    train = P.time_split(lab).where(F.col("split") == "train")
    m = E.fit_woe(train, _LOW, "is_fraud")
    return rounded(m.transform(lab).select("id", *[f"{c}_woe" for c in _LOW]))


@register("F4_target_encoding_fit", with_apps(LABELLED_CTES + _te_sql(_HIGH) + """
SELECT "column", value, round(te, 6) AS te FROM te"""))
def f4(spark, sf):
    return rounded(E.fit_target(labelled(spark, sf), _HIGH, "is_fraud").table)


@register("F5_target_transform", with_apps(LABELLED_CTES + _P1_SQL + _TRAIN + _te_sql(_HIGH, "trn") + """
SELECT l.id, """ + ", ".join(
    f"round(coalesce((SELECT te FROM te WHERE \"column\" = '{c}' AND value = coalesce(CAST(l.{c} AS VARCHAR), "
    f"'__NA__')), (SELECT m FROM gm)), 6) AS {c}_te" for c in _HIGH) + " FROM labelled l"))
def f5(spark, sf):
    lab = materialise(labelled(spark, sf, "id", "issue_d", *_HIGH).select("id", "issue_d", *_HIGH, "is_fraud"), "target-input")
    train = P.time_split(lab).where(F.col("split") == "train")
    m = E.fit_target(train, _HIGH, "is_fraud")
    return rounded(m.transform(lab).select("id", *[f"{c}_te" for c in _HIGH]))


# numeric base columns of the applications view (installment derived by N7)
_NUM = ["loan_amnt", "int_rate", "installment", "annual_inc", "dti", "delinq_2yrs", "open_acc", "pub_rec",
        "revol_bal", "revol_util", "total_acc", "emp_length", "term"]
_INST = "round(loan_amnt * (int_rate / 1200e0) / (1e0 - pow(1e0 + int_rate / 1200e0, -term)), 2)"


def _num_frame(spark, sf):
    a = applications(spark, sf)
    return a.withColumn("installment", N.installment("loan_amnt", "int_rate", "term")).select(*_NUM)


def _bounds_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(quantile_cont({c}, 5e-3), 6) AS lo, round(quantile_cont({c}, 995e-3), 6) "
        f"AS hi FROM src" for c in _NUM)
    clipped = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x FROM src" for c in _NUM)
    return f"""
, src AS (SELECT *, {_INST} AS installment FROM applications),
bnd AS ({parts}),
cl AS (SELECT feature, CASE WHEN x < lo THEN lo WHEN x > hi THEN hi ELSE x END AS x
       FROM ({clipped}) JOIN bnd USING (feature) WHERE x IS NOT NULL),
med AS (SELECT feature, round(quantile_cont(x, 5e-1), 6) AS median FROM cl GROUP BY feature)
"""


@register("F6_winsor_bounds", with_apps(_bounds_sql() + "SELECT feature, lo, hi FROM bnd"))
def f6(spark, sf):
    bounds, _ = FB.winsor_and_medians(_num_frame(spark, sf), _NUM)
    return spark.createDataFrame([(c, lo, hi) for c, (lo, hi) in bounds.items()], "feature string, lo double, hi double")


@register("F7_median_impute", with_apps(_bounds_sql() + "SELECT feature, median FROM med"))
def f7(spark, sf):
    _, med = FB.winsor_and_medians(_num_frame(spark, sf), _NUM)
    return spark.createDataFrame([(c, m) for c, m in med.items()], "feature string, median double")


@register("F7_imputed_matrix", with_apps(_bounds_sql() + """
, lng AS (SELECT id, feature, x FROM (SELECT *, {inst} AS installment FROM applications)
          UNPIVOT INCLUDE NULLS (x FOR feature IN ({cols})))
SELECT id, feature, round(coalesce(CASE WHEN x < lo THEN lo WHEN x > hi THEN hi ELSE x END, median), 6) AS value
FROM lng JOIN bnd USING (feature) JOIN med USING (feature)""".format(inst=_INST, cols=", ".join(_NUM))))
def f7_matrix(spark, sf):
    a = applications(spark, sf).withColumn("installment", N.installment("loan_amnt", "int_rate", "term"))
    bounds, med = FB.winsor_and_medians(a.select(*_NUM), _NUM)
    wide = a.select("id", *FB.numeric_block(a, _NUM, bounds, med))
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in _NUM]))
    return rounded(wide.select("id", stacked.alias("kv")).select("id", "kv.feature", "kv.value"))


@register("F8_standard_scaler", with_apps(_bounds_sql() + """
, lng AS (SELECT feature, x FROM (SELECT *, {inst} AS installment FROM applications)
          UNPIVOT INCLUDE NULLS (x FOR feature IN ({cols}))),
imp AS (SELECT feature, coalesce(CASE WHEN x < lo THEN lo WHEN x > hi THEN hi ELSE x END, median) AS v
        FROM lng JOIN bnd USING (feature) JOIN med USING (feature))
SELECT feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM imp GROUP BY feature
""".format(inst=_INST, cols=", ".join(_NUM))))
def f8(spark, sf):
    a = _num_frame(spark, sf)
    bounds, med = FB.winsor_and_medians(a, _NUM)
    imp = a.select(*FB.numeric_block(a, _NUM, bounds, med))
    row = imp.agg(*[F.avg(c).alias(f"m_{c}") for c in _NUM], *[F.stddev_pop(c).alias(f"s_{c}") for c in _NUM]).first()
    return rounded(spark.createDataFrame([(c, row[f"m_{c}"], row[f"s_{c}"]) for c in _NUM],
                                         "feature string, mean double, std double"))


@register("F11_numeric_coercion", with_apps("""
SELECT id, loan_amnt, annual_inc, dti, delinq_2yrs, CAST(NULL AS DOUBLE) AS grade_num FROM applications"""))
def f11(spark, sf):
    r = raw_applications(spark, sf)
    return rounded(r.select(F.col("id").cast("long").alias("id"), *[to_double(c).alias(c) for c in
                                                                    ("loan_amnt", "annual_inc", "dti", "delinq_2yrs")],
                            to_double("grade").alias("grade_num")))


def _feature_input(spark, sf):
    """What the feature pipeline reads, written once: fits and transforms pass over it several times."""
    lab = labelled(spark, sf).withColumn("installment", N.installment("loan_amnt", "int_rate", "term"))
    return materialise(lab.drop("rule_fpd", "rule_income_anomaly", "rule_debt_inconsist", "rule_address_ring",
                                "n_anomalies", "loan_status", "last_pymnt_d", "score"), "feature-input")


def f9(spark, sf):
    """Fit the feature pipeline on the time-split train rows, transform every row."""
    lab = _feature_input(spark, sf)
    train = P.time_split(lab).where(F.col("split") == "train")
    model = FB.FeatureBuilder().fit(train)
    return rounded(model.transform(lab))


# ---------------------------------------------------------------- GR1-GR5
# Graph fixture: link keys zip_code, emp_title and the loan amount in hundreds.

_LINK = ["zip_code", "emp_title", "loan_link"]


def _graph_input(spark, sf):
    a = applications(spark, sf).select("id", "zip_code", "emp_title",
                                       F.floor(F.col("loan_amnt") / 100).cast("int").alias("loan_link"))
    return materialise(a, "graph-input")


def _linked_sql(src: str, p: str = "") -> str:
    """CTEs over ``src`` (id, k0, k1, k2; NULL never links), names prefixed by ``p``.

    ``{p}w``: per key pair the block size and smallest id; ``{p}deg``: rows that share two keys or more;
    ``{p}comp``: smallest id reachable over stars around the blocks' smallest ids.
    """
    def block(*ks):
        name, part = "".join(ks), ", ".join(f"k{k}" for k in ks)
        there = " AND ".join(f"k{k} IS NOT NULL" for k in ks)
        return (f"CASE WHEN {there} THEN count(*) OVER (PARTITION BY {part}) END AS n{name}, "
                f"CASE WHEN {there} THEN min(id) OVER (PARTITION BY {part}) END AS m{name}")
    stars = " UNION ".join(f"SELECT id AS a, m{x} AS b FROM {p}w WHERE m{x} <> id" for x in ("01", "02", "12"))
    return f"""
, {p}w AS (SELECT id, k0, k1, k2, {block("0", "1")}, {block("0", "2")}, {block("1", "2")}, {block("0", "1", "2")} FROM {src}),
{p}deg AS (SELECT id AS node, coalesce(n01, 0) + coalesce(n02, 0) + coalesce(n12, 0) - 2 * coalesce(n012, 0)
             - CASE WHEN coalesce(n01, n02, n12) IS NULL THEN 0 ELSE 1 END AS d FROM {p}w),
{p}st AS ({stars}),
{p}ud AS (SELECT a, b FROM {p}st UNION SELECT b, a FROM {p}st),
{p}comp(node, component) USING KEY (node) AS (
  SELECT DISTINCT a, a FROM {p}ud
  UNION
  (SELECT e.b, min(r.component) FROM {p}comp r JOIN {p}ud e ON e.a = r.node JOIN recurring.{p}comp t ON t.node = e.b
   WHERE r.component < t.component GROUP BY e.b)),
{p}csize AS (SELECT component, count(*) AS size FROM {p}comp GROUP BY component)"""


_G_SQL = """
, g AS (SELECT id, CAST(zip_code AS VARCHAR) AS k0, CAST(emp_title AS VARCHAR) AS k1,
               CAST(CAST(floor(loan_amnt / 100) AS INTEGER) AS VARCHAR) AS k2 FROM applications)
""" + _linked_sql("g")


def _graph_sql(body: str) -> str:
    return with_apps(_G_SQL + body).replace("WITH applications AS (", "WITH RECURSIVE applications AS (", 1)


@register("GR1_blocking", with_apps(_G_SQL.split(", w AS")[0] + """
SELECT id, CASE WHEN count(k0) OVER (PARTITION BY k0) >= 2 THEN k0 END AS key0,
       CASE WHEN count(k1) OVER (PARTITION BY k1) >= 2 THEN k1 END AS key1,
       CASE WHEN count(k2) OVER (PARTITION BY k2) >= 2 THEN k2 END AS key2 FROM g"""))
def gr1(spark, sf):
    return GR.blocked_keys(_graph_input(spark, sf), _LINK)


@register("GR2_linkage", _graph_sql("""
SELECT id, 'zip_code+emp_title' AS link_keys, n01 AS members FROM w WHERE n01 >= 2
UNION ALL SELECT id, 'zip_code+loan_link', n02 FROM w WHERE n02 >= 2
UNION ALL SELECT id, 'emp_title+loan_link', n12 FROM w WHERE n12 >= 2"""))
def gr2(spark, sf):
    """Every row's place in the hubs of two shared keys; the pairs themselves grow with the square of a block."""
    return GR.linkage(_graph_input(spark, sf), _LINK).select("id", "link_keys", "members")


@register("GR2_links_of_asked", _graph_sql("""
SELECT a.id, b.id AS partner,
  CAST(coalesce(CAST(a.k0 = b.k0 AS INTEGER), 0) + coalesce(CAST(a.k1 = b.k1 AS INTEGER), 0)
       + coalesce(CAST(a.k2 = b.k2 AS INTEGER), 0) AS INTEGER) AS weight
FROM (SELECT * FROM g WHERE id % 20 = 0) a
JOIN g b ON a.id <> b.id AND ((a.k0 = b.k0 AND a.k1 = b.k1) OR (a.k0 = b.k0 AND a.k2 = b.k2) OR (a.k1 = b.k1 AND a.k2 = b.k2))"""))
def gr2_asked(spark, sf):
    """Partners of the asked ids (every id divisible by 20) among all rows."""
    a = _graph_input(spark, sf)
    return GR.links_of(a, a.where("id % 20 = 0").select("id"), _LINK)


@register("GR3_components", _graph_sql("SELECT node, component FROM comp"))
def gr3(spark, sf):
    return GR.components(GR.star_links(_graph_input(spark, sf), _LINK))


@register("GR4_graph_features", _graph_sql("""
SELECT a.id, CAST(coalesce(cs.size, 1) AS INTEGER) AS graph_component_size, coalesce(deg.d, 0) AS graph_degree,
       CAST(CASE WHEN coalesce(deg.d, 0) = 0 THEN 1 ELSE 0 END AS INTEGER) AS graph_isolated
FROM applications a LEFT JOIN comp ON comp.node = a.id LEFT JOIN csize cs ON cs.component = comp.component
LEFT JOIN deg ON deg.node = a.id"""))
def gr4(spark, sf):
    feats = GR.build_graph_features(_graph_input(spark, sf), link_keys=_LINK)
    return feats.select("id", "graph_component_size", "graph_degree", "graph_isolated")


@register("GR5_graph_summary", _graph_sql("""
SELECT (SELECT count(*) FROM applications) AS n_nodes, (SELECT CAST(sum(d) // 2 AS BIGINT) FROM deg) AS n_edges,
       (SELECT count(*) FROM applications) - (SELECT count(*) FROM comp)
         + (SELECT count(DISTINCT component) FROM comp) AS n_components,
       (SELECT coalesce(max(size), 1) FROM csize) AS largest_component"""))
def gr5(spark, sf):
    return GR.graph_summary(_graph_input(spark, sf), _LINK)


_G_TEST_SQL = _graph_sql("""
SELECT a.id, CAST(coalesce(cs.size, 1) AS INTEGER) AS graph_component_size, coalesce(deg.d, 0) AS graph_degree,
       CAST(CASE WHEN coalesce(deg.d, 0) = 0 THEN 1 ELSE 0 END AS INTEGER) AS graph_isolated
FROM applications a JOIN s ON s.id = a.id AND s.split = 'test' LEFT JOIN comp ON comp.node = a.id
LEFT JOIN csize cs ON cs.component = comp.component LEFT JOIN deg ON deg.node = a.id""").replace(", g AS", _P1_SQL + ", g AS", 1)


def _graph_splits(spark, sf):
    a = applications(spark, sf).select("id", "issue_d", "zip_code", "emp_title", F.floor(F.col("loan_amnt") / 100).cast("int").alias("loan_link"))
    s = materialise(P.time_split(materialise(a, "graph-input")), "graph-splits")
    return [s.where(F.col("split") == x).drop("split", "issue_d") for x in ("train", "val", "test")]


@register("GR4_graph_with_history", _G_TEST_SQL)
def gr4_history(spark, sf):
    """Test-period rows against the stored graph of the rows before them, which was itself built in two steps.
    The twin builds the graph of all rows at once."""
    train, val, test = _graph_splits(spark, sf)
    state = GS.empty_state(spark)
    for part in (train, val):
        state = GS.GraphState(*[materialise(t, "graph-state") for t in vars(GS.merged(state, GS.link_batch(part, state, _LINK))).values()])
    return GS.graph_features_with_history(test, state, _LINK).select("id", "graph_component_size", "graph_degree", "graph_isolated")


@register("S3_GR4_stream_state", _G_TEST_SQL)
def s3_graph(spark, sf):
    """The same through a stream that is stopped and started between three deliveries and keeps its graph."""
    src, sink, state, progress = (scratch_path(spark, f"graph-stream-{x}") for x in ("source", "sink", "state", "progress"))
    parts = _graph_splits(spark, sf)
    for part in parts:
        part.write.mode("append").parquet(src)
        ST.graph_stream(spark, src, part.schema, sink, state, progress, _LINK, compact_every=1)
    return spark.read.parquet(sink).join(parts[-1].select("id"), "id", "left_semi").drop("epoch")


def _f10_sql() -> str:
    from .prep import _bucket_sql
    from .windows import _DAY, _KEYS, _WINS
    inst = "round(loan_amnt * (int_rate / 1200e0) / (1e0 - pow(1e0 + int_rate / 1200e0, -term)), 2)"
    vel = []
    for i, k in enumerate(_KEYS):
        cols = ", ".join(f"CAST(count(b.id) FILTER (WHERE b.t >= a.t - {w}) AS INTEGER) AS vel_{k}_{w}d" for w in _WINS)
        vel.append(f"""v{i} AS (
  SELECT a.id, {cols}
  FROM (SELECT id, CAST({k} AS VARCHAR) AS kv, {_DAY} AS t FROM applications) a
  LEFT JOIN (SELECT id, CAST({k} AS VARCHAR) AS kv, {_DAY} AS t FROM applications) b
    ON a.kv = b.kv AND b.t >= a.t - {max(_WINS)} AND (b.t < a.t OR (b.t = a.t AND b.id < a.id))
  GROUP BY a.id)""")
    graph = _G_SQL.replace(
        "CAST(CAST(floor(loan_amnt / 100) AS INTEGER) AS VARCHAR) AS k2 FROM applications",
        "CAST(income_bucket AS VARCHAR) AS k2 FROM applications JOIN b_income_bucket USING (id)")
    vcols = ", ".join(f"vel_{k}_{w}d" for k in _KEYS for w in _WINS)
    body = (_bucket_sql("annual_inc", "income_bucket") + _bucket_sql("loan_amnt", "loan_bucket") + ", "
            + ",\n".join(vel) + graph + f"""
SELECT a.id,
  round(loan_amnt / nullif(annual_inc, 0), 6) AS loan_to_income,
  round({inst} * 12 / nullif(annual_inc, 0), 6) AS installment_to_income,
  round(revol_bal / nullif(annual_inc, 0), 6) AS revol_bal_to_income,
  round(greatest(datediff('day', earliest_cr_line, issue_d) / 365.25e0, 0e0), 6) AS credit_history_years,
  round(open_acc / nullif(total_acc, 0), 6) AS pct_open_acc,
  coalesce(delinq_2yrs, 0e0) + coalesce(pub_rec, 0e0) AS n_negative_events,
  CAST(coalesce(dti > 35, false) AS INTEGER) AS flag_high_dti,
  CAST(coalesce(emp_length, 0e0) = 0 AS INTEGER) AS flag_no_employment,
  bi.income_bucket, bl2.loan_bucket,
  CAST(month(issue_d) AS INTEGER) AS app_month, CAST(quarter(issue_d) AS INTEGER) AS app_quarter,
  CAST(year(issue_d) AS INTEGER) AS app_year,
  CAST(length(coalesce(title, '')) AS INTEGER) AS title_len,
  round(length(regexp_replace(coalesce(title, ''), '[^0-9]', '', 'g')) / greatest(length(coalesce(title, '')), 1), 6)
    AS title_digit_ratio,
  CAST(length(coalesce(emp_title, '')) AS INTEGER) AS emp_title_len,
  round(length(regexp_replace(coalesce(emp_title, ''), '[^0-9]', '', 'g'))
        / greatest(length(coalesce(emp_title, '')), 1), 6) AS emp_title_digit_ratio,
  {vcols},
  CAST(coalesce(cs.size, 1) AS INTEGER) AS graph_component_size,
  coalesce(deg.d, 0) AS graph_degree, CAST(CASE WHEN coalesce(deg.d, 0) = 0 THEN 1 ELSE 0 END AS INTEGER) AS graph_isolated
FROM applications a JOIN b_income_bucket bi USING (id) JOIN b_loan_bucket bl2 USING (id)
JOIN v0 USING (id) JOIN v1 USING (id) JOIN v2 USING (id)
LEFT JOIN comp ON comp.node = a.id LEFT JOIN csize cs ON cs.component = comp.component
LEFT JOIN deg ON deg.node = a.id""")
    return with_apps(body).replace("WITH applications AS (", "WITH RECURSIVE applications AS (", 1)


@register("F10_engineered_frame", _f10_sql())
def f10(spark, sf):
    """Behavioural + velocity + graph features of the applications (default link keys; keyed by id)."""
    a = applications(spark, sf).withColumn("installment", N.installment("loan_amnt", "int_rate", "term"))
    a = materialise(a.drop("loan_status", "last_pymnt_d", "score", "grade", "home_ownership", "purpose", "revol_util"),
                    "engineer-input")
    eng = FB.engineer(a, use_velocity=True, use_graph=True)
    keep = [c for c in eng.columns if c not in a.columns or c == "id"]
    return rounded(eng.select(*keep))


def io6(spark, sf):
    """Fit the feature pipeline on train, persist it (Parquet + JSON), reload, transform the test split."""
    from ...sources.io import scratch_path
    s = P.time_split(_feature_input(spark, sf))
    model = FB.FeatureBuilder(use_graph=False).fit(s.where(F.col("split") == "train"))
    path = scratch_path(spark, "feature-state")
    model.save(path)
    loaded = FB.FeatureModel.load(spark, path)
    return rounded(loaded.transform(s.where(F.col("split") == "test")))


# ---------------------------------------------------------------- F9 oracle: engineered features of any relation

_DEC = "[0e0, 1e-1, 2e-1, 3e-1, 4e-1, 5e-1, 6e-1, 7e-1, 8e-1, 9e-1, 1e0]"


def _eng_sql(src: str, p: str) -> str:
    """CTEs computing the engineered numeric features of relation ``src`` (all names prefixed by ``p``).

    Ends with CTE ``{p}eng``: id + every numeric feature of the builder (buckets, velocity-free, graph on
    the default link keys zip_code / emp_title / income_bucket), computed within ``src``.
    """
    def bucket(col, out):
        return f"""
, {p}q_{out} AS (SELECT unnest(quantile_cont({col}, {_DEC})) AS e FROM {src} WHERE {col} IS NOT NULL),
{p}e_{out} AS (SELECT DISTINCT round(e, 6) AS e FROM {p}q_{out}),
{p}m_{out} AS (SELECT count(*) AS m FROM {p}e_{out}),
{p}b_{out} AS (
  SELECT x.id, CASE WHEN x.{col} IS NULL OR (SELECT m FROM {p}m_{out}) < 2 THEN NULL
    ELSE CAST(least(greatest((SELECT count(*) FROM {p}e_{out} WHERE {p}e_{out}.e < x.{col}) - 1, 0),
                    (SELECT m FROM {p}m_{out}) - 2) AS INTEGER) END AS {out}
  FROM {src} x)"""
    return bucket("annual_inc", "income_bucket") + bucket("loan_amnt", "loan_bucket") + f"""
, {p}g AS (SELECT x.id, CAST(x.zip_code AS VARCHAR) AS k0, CAST(x.emp_title AS VARCHAR) AS k1,
                  CAST(b.income_bucket AS VARCHAR) AS k2 FROM {src} x JOIN {p}b_income_bucket b USING (id))""" + _linked_sql(f"{p}g", p) + f""",
{p}eng AS (
  SELECT x.id, x.loan_amnt, x.int_rate, x.installment, x.annual_inc, x.dti, x.delinq_2yrs, x.open_acc, x.pub_rec,
    x.revol_bal, x.revol_util, x.total_acc, x.emp_length, x.term,
    x.loan_amnt / nullif(x.annual_inc, 0) AS loan_to_income,
    x.installment * 12 / nullif(x.annual_inc, 0) AS installment_to_income,
    x.revol_bal / nullif(x.annual_inc, 0) AS revol_bal_to_income,
    greatest(datediff('day', x.earliest_cr_line, x.issue_d) / 365.25e0, 0e0) AS credit_history_years,
    x.open_acc / nullif(x.total_acc, 0) AS pct_open_acc,
    coalesce(x.delinq_2yrs, 0e0) + coalesce(x.pub_rec, 0e0) AS n_negative_events,
    CAST(coalesce(x.dti > 35, false) AS DOUBLE) AS flag_high_dti,
    CAST(coalesce(x.emp_length, 0e0) = 0 AS DOUBLE) AS flag_no_employment,
    CAST(month(x.issue_d) AS DOUBLE) AS app_month, CAST(quarter(x.issue_d) AS DOUBLE) AS app_quarter,
    CAST(year(x.issue_d) AS DOUBLE) AS app_year,
    CAST(length(coalesce(x.title, '')) AS DOUBLE) AS title_len,
    length(regexp_replace(coalesce(x.title, ''), '[^0-9]', '', 'g')) / greatest(length(coalesce(x.title, '')), 1)
      AS title_digit_ratio,
    CAST(length(coalesce(x.emp_title, '')) AS DOUBLE) AS emp_title_len,
    length(regexp_replace(coalesce(x.emp_title, ''), '[^0-9]', '', 'g')) / greatest(length(coalesce(x.emp_title, '')), 1)
      AS emp_title_digit_ratio,
    CAST(coalesce(cs.size, 1) AS DOUBLE) AS graph_component_size, CAST(coalesce(dg.d, 0) AS DOUBLE) AS graph_degree,
    CAST(coalesce(dg.d, 0) = 0 AS DOUBLE) AS graph_isolated
  FROM {src} x LEFT JOIN {p}comp cp ON cp.node = x.id LEFT JOIN {p}csize cs ON cs.component = cp.component
  LEFT JOIN {p}deg dg ON dg.node = x.id)
"""


_F9_NUM = ["loan_amnt", "int_rate", "installment", "annual_inc", "dti", "delinq_2yrs", "open_acc", "pub_rec",
           "revol_bal", "revol_util", "total_acc", "emp_length", "term", "loan_to_income", "installment_to_income",
           "revol_bal_to_income", "credit_history_years", "pct_open_acc", "n_negative_events", "flag_high_dti",
           "flag_no_employment", "app_month", "app_quarter", "app_year", "title_len", "title_digit_ratio",
           "emp_title_len", "emp_title_digit_ratio", "graph_component_size", "graph_degree", "graph_isolated"]


def _f9_sql(graph: bool = True, only_split: str | None = None) -> str:
    num_cols = _F9_NUM if graph else [c for c in _F9_NUM if not c.startswith("graph_")]
    inst = "round(loan_amnt * (int_rate / 1200e0) / (1e0 - pow(1e0 + int_rate / 1200e0, -term)), 2)"
    cols = ", ".join(num_cols)
    head = LABELLED_CTES + _P1_SQL + f"""
, lab2 AS (SELECT *, {inst} AS installment FROM labelled),
trn AS (SELECT l.* FROM lab2 l JOIN s USING (id) WHERE s.split = 'train')
"""
    fit = f"""
, tl AS (SELECT feature, x FROM (SELECT {cols} FROM t_eng) UNPIVOT (x FOR feature IN ({cols}))),
bnd AS (SELECT feature, round(quantile_cont(x, 5e-3), 6) AS lo, round(quantile_cont(x, 995e-3), 6) AS hi
        FROM tl GROUP BY feature),
med AS (SELECT feature, round(quantile_cont(CASE WHEN x < lo THEN lo WHEN x > hi THEN hi ELSE x END, 5e-1), 6)
          AS median FROM tl JOIN bnd USING (feature) GROUP BY feature)
"""
    def num(c):
        lo = f"(SELECT lo FROM bnd WHERE feature = '{c}')"
        hi = f"(SELECT hi FROM bnd WHERE feature = '{c}')"
        med = f"(SELECT median FROM med WHERE feature = '{c}')"
        x = f"ae.{c}"
        return (f"round(coalesce(coalesce(CASE WHEN {x} < {lo} THEN {lo} WHEN {x} > {hi} THEN {hi} ELSE {x} END, "
                f"{med}), 0e0), 6) AS {c}")
    woe_cols = ["grade", "home_ownership", "purpose", "addr_state"]
    te_cols = ["emp_title", "zip_code"]
    enc = ", ".join(
        [f"round(coalesce((SELECT woe FROM wt WHERE \"column\" = '{c}' AND value = coalesce(CAST(l.{c} AS VARCHAR), "
         f"'__NA__')), 0e0), 6) AS {c}_woe" for c in woe_cols] +
        [f"round(coalesce((SELECT te FROM te WHERE \"column\" = '{c}' AND value = coalesce(CAST(l.{c} AS VARCHAR), "
         f"'__NA__')), (SELECT m FROM gm)), 6) AS {c}_te" for c in te_cols])
    body = (head + _eng_sql("trn", "t_") + _eng_sql("lab2", "a_") + fit + _woe_sql(woe_cols, "trn")
            + _te_sql(te_cols, "trn") + f"""
SELECT ae.id, {", ".join(num(c) for c in num_cols)}, {enc}
FROM a_eng ae JOIN lab2 l USING (id)""" + (f" JOIN s USING (id) WHERE s.split = '{only_split}'" if only_split else ""))
    return with_apps(body).replace("WITH applications AS (", "WITH RECURSIVE applications AS (", 1)


ORACLE_F9 = _f9_sql()

register("F9_feature_matrix", ORACLE_F9)(f9)
register("IO6_feature_state_roundtrip", _f9_sql(graph=False, only_split="test"))(io6)
