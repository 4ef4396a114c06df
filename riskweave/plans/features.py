"""F6-F11 and IO6: the fitted feature pipeline.

``FeatureBuilder.fit(df)`` runs the engineering steps (B1-B7, optional W1, GR)
on the training frame, then fits, with as few passes as possible:

* F6/F7 winsor bounds (0.5%, 99.5%) and medians of the clipped columns: ONE
  exact order-statistics sort of all numeric columns (clip is monotone, so
  the clipped median is the interpolation of clipped order statistics);
* F8 mean / population std of the imputed columns: an aggregate per few columns;
* F1/F4 encoders: one grouped aggregation for both.

``FeatureModel.transform(df)`` re-engineers the given frame (window, graph and
bucket features are computed within the frame, as the reference does), clips,
imputes, joins the encodings and returns ``id`` + the features in fixed order
with NULL and +-inf replaced by 0. ``assemble`` adds a ``features`` vector
for ``pyspark.ml``. ``save``/``load`` persist the fitted state as Parquet
tables and one JSON document under a folder.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import partial

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import NumericType

from ..functions.exprs import nan_to_null, to_double
from ..operators import behavior as B
from ..operators import encode as E
from ..operators import graph as GR
from ..operators import graph_state as GS
from ..operators import velocity as W
from ..operators.ordering import interpolate, quantiles
from ..sources.scratch import materialise, side_by_side

# The feature lists of the reference builder, in order.
NUMERIC_BASE = ["loan_amnt", "int_rate", "installment", "annual_inc", "dti", "delinq_2yrs", "inq_last_6mths",
                "open_acc", "pub_rec", "revol_bal", "revol_util", "total_acc", "mort_acc", "pub_rec_bankruptcies",
                "emp_length", "term"]
NUMERIC_DERIVED = ["loan_to_income", "installment_to_income", "revol_bal_to_income", "credit_history_years",
                   "pct_open_acc", "n_negative_events", "flag_high_dti", "flag_no_employment", "app_month",
                   "app_quarter", "app_year", "title_len", "title_digit_ratio", "emp_title_len",
                   "emp_title_digit_ratio", "graph_component_size", "graph_degree", "graph_isolated"]
CATEGORICAL_LOW = ["grade", "home_ownership", "verification_status", "purpose", "addr_state"]
CATEGORICAL_HIGH = ["sub_grade", "emp_title", "zip_code"]
WINSOR = (0.005, 0.995)
COLUMNS_AT_ONCE = 8     # columns whose mean and std come from one aggregate


def engineer(df: DataFrame, use_velocity: bool = False, use_graph: bool = True,
             link_keys=GR.DEFAULT_LINK_KEYS, velocity_state: DataFrame | None = None, edges: dict | None = None) -> DataFrame:
    """behavioural (+ velocity) (+ graph) features of the frame; rows keyed by ``id``.

    With ``velocity_state`` (a stored history snapshot, ``velocity.velocity_state``)
    velocity counts include the history, as a scoring batch needs; without it
    they are computed within the frame, as the reference does. So are the bucket edges (B5) unless ``edges`` gives them.
    """
    out = B.build_behavioral_features(df, edges)
    if use_velocity:
        out = (W.build_velocity_with_history(out, velocity_state) if velocity_state is not None
               else W.build_velocity_features(out))
    if use_graph:
        out = GR.build_graph_features(out, link_keys=link_keys)
    return out


def engineer_with_state(model: "FeatureModel", df: DataFrame, velocity_state: DataFrame | None,
                        graph_state: GS.GraphState | None) -> tuple[DataFrame, GS.GraphUpdate | None]:
    """F10 of arriving rows, velocity and graph counted with the stored state of the rows before them.

    Buckets take the edges of the training rows, so a bucket is the same link key in every batch.
    """
    if graph_state is None or not model.use_graph:
        return engineer(df, model.use_velocity, model.use_graph, model.link_keys, velocity_state), None
    out = materialise(engineer(df, model.use_velocity, False, velocity_state=velocity_state, edges=model.edges), "engineered")
    keys = [k for k in model.link_keys if k in out.columns]
    update = GS.link_batch(out, graph_state, keys)
    return out.join(update.features, "id"), update


def winsor_and_medians(df: DataFrame, cols: list[str], q=WINSOR, stored: bool = False):
    """{col: (lo, hi)} and {col: median after clipping}, from one sort."""
    pts = quantiles(df, cols, [q[0], q[1], 0.5], points=True, stored=stored)
    bounds, medians = {}, {}
    for c in cols:
        lo_p, hi_p, med_p = pts[c]
        if lo_p is None:
            bounds[c], medians[c] = (None, None), None
            continue
        lo = round(interpolate(*lo_p), 6)
        hi = round(interpolate(*hi_p), 6)
        a, b, frac = med_p
        bounds[c] = (lo, hi)
        medians[c] = round(interpolate(min(max(a, lo), hi), min(max(b, lo), hi), frac), 6)
    return bounds, medians


def as_double(df: DataFrame, c: str):
    """F11 coercion: numeric columns are cast (NaN -> NULL); only text goes through parsing."""
    if c not in df.columns:
        return F.lit(None).cast("double")
    if isinstance(df.schema[c].dataType, NumericType):
        return nan_to_null(F.col(c).cast("double"))
    return to_double(c)


def numeric_block(df: DataFrame, cols, bounds, medians) -> list:
    """F11 + F6 + F7 column expressions: coerce, clip, impute."""
    out = []
    for c in cols:
        x = as_double(df, c)
        lo, hi = bounds.get(c, (None, None))
        med = medians.get(c)
        if lo is None or hi is None:
            out.append((F.coalesce(x, F.lit(float(med))) if med is not None else x).alias(c))
            continue
        # nested conditions repeat their input, and the generated code of all columns gets very large and slow per row
        missing = x.isNull()
        if c in df.columns and isinstance(df.schema[c].dataType, NumericType):
            x = F.col(c).cast("double")
            missing = x.isNull() | F.isnan(x)
        clipped = F.greatest(F.least(x, F.lit(float(hi))), F.lit(float(lo)))      # these skip NULL: it never gets here
        out.append(F.when(missing, F.lit(None if med is None else float(med)).cast("double")).otherwise(clipped).alias(c))
    return out


def _moments(coerced: DataFrame, cols, bounds, medians) -> dict:
    """F8: {column: (mean, population std)} of the imputed columns."""
    def of(some: list[str]) -> dict:
        row = coerced.select(*numeric_block(coerced, some, bounds, medians)).agg(
            *[F.avg(c).alias(f"m_{c}") for c in some], *[F.stddev_pop(c).alias(f"s_{c}") for c in some]).first()
        return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in some}

    # a few columns at a time, each scanned once: the generated code of one aggregate over all of them is very large and slow per row
    parts = side_by_side(coerced.sparkSession, [partial(of, cols[i:i + COLUMNS_AT_ONCE]) for i in range(0, len(cols), COLUMNS_AT_ONCE)])
    return {c: s for part in parts for c, s in part.items()}


def _finite(c: str):
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x).alias(c)


@dataclass
class FeatureModel:
    numeric_cols: list[str]
    low_cols: list[str]
    high_cols: list[str]
    bounds: dict
    medians: dict
    scaler: dict
    woe: E.WoEModel | None
    te: E.TargetModel | None
    use_velocity: bool = False
    use_graph: bool = True
    link_keys: tuple = GR.DEFAULT_LINK_KEYS
    feature_names: list[str] = field(default_factory=list)
    edges: dict = field(default_factory=dict)      # B5 bucket edges of the training rows

    def transform(self, df: DataFrame, id_col: str = "id", velocity_state: DataFrame | None = None,
                  engineered: bool = False) -> DataFrame:
        """id + features (fixed order, no NULL/NaN/inf); ``engineered``: ``df`` has its F10 columns already."""
        eng = df if engineered else engineer(df, self.use_velocity, self.use_graph, self.link_keys, velocity_state)
        out = eng.select(F.col(id_col), *[F.col(c) for c in self.low_cols + self.high_cols if c in eng.columns],
                         *numeric_block(eng, self.numeric_cols, self.bounds, self.medians))
        if self.woe is not None:
            out = self.woe.transform(out)
        if self.te is not None:
            out = self.te.transform(out)
        return out.select(id_col, *[_finite(c) if c in out.columns else F.lit(0.0).alias(c)
                                    for c in self.feature_names])

    def assemble(self, features: DataFrame, output_col: str = "features") -> DataFrame:
        return VectorAssembler(inputCols=self.feature_names, outputCol=output_col).transform(features)

    # ---- IO6: persistence
    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        meta = {"numeric_cols": self.numeric_cols, "low_cols": self.low_cols, "high_cols": self.high_cols,
                "bounds": self.bounds, "medians": self.medians, "scaler": self.scaler,
                "use_velocity": self.use_velocity, "use_graph": self.use_graph, "link_keys": list(self.link_keys),
                "feature_names": self.feature_names, "edges": self.edges,
                "woe_cols": self.woe.cols if self.woe else None, "woe_unknown": self.woe.unknown_value if self.woe else None,
                "te_cols": self.te.cols if self.te else None, "te_mean": self.te.global_mean if self.te else None}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").json(
            f"{path}/meta")
        if self.woe is not None:
            self.woe.table.write.mode("overwrite").parquet(f"{path}/woe")
            self.woe.iv.write.mode("overwrite").parquet(f"{path}/iv")
        if self.te is not None:
            self.te.table.write.mode("overwrite").parquet(f"{path}/te")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FeatureModel":
        meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        woe = (E.WoEModel(meta["woe_cols"], spark.read.parquet(f"{path}/woe"), spark.read.parquet(f"{path}/iv"),
                          meta["woe_unknown"]) if meta["woe_cols"] is not None else None)
        te = (E.TargetModel(meta["te_cols"], spark.read.parquet(f"{path}/te"), meta["te_mean"])
              if meta["te_cols"] is not None else None)
        return FeatureModel(meta["numeric_cols"], meta["low_cols"], meta["high_cols"],
                            {k: tuple(v) for k, v in meta["bounds"].items()}, meta["medians"], meta["scaler"],
                            woe, te, meta["use_velocity"], meta["use_graph"], tuple(meta["link_keys"]),
                            meta["feature_names"], meta["edges"])


@dataclass
class FeatureBuilder:
    winsorize_quantiles: tuple = WINSOR
    use_velocity: bool = False
    use_graph: bool = True
    link_keys: tuple = GR.DEFAULT_LINK_KEYS

    def engineer(self, df: DataFrame) -> tuple[DataFrame, dict]:
        """F10 of the frame and its bucket edges."""
        edges = B.bucket_edges(df)
        return engineer(df, self.use_velocity, self.use_graph, self.link_keys, edges=edges), edges

    def fit(self, df: DataFrame, y: str = "is_fraud", id_col: str = "id") -> FeatureModel:
        return self.fit_engineered(*self.engineer(df), y)

    def fit_engineered(self, eng: DataFrame, edges: dict, y: str = "is_fraud") -> FeatureModel:
        """The fit on what ``engineer`` gave, for callers that also transform those rows."""
        numeric = [c for c in NUMERIC_BASE + NUMERIC_DERIVED if c in eng.columns]
        low = [c for c in CATEGORICAL_LOW if c in eng.columns]
        high = [c for c in CATEGORICAL_HIGH if c in eng.columns]
        # the fits below each read it: only what they use, as columns, so each scans its own
        eng = materialise(eng.select(*[as_double(eng, c).alias(c) for c in numeric], *low, *high, y), "fit-input")
        coerced, labelled = eng.select(*numeric), eng.select(*low, *high, F.col(y))
        (bounds, medians), (woe, te) = side_by_side(eng.sparkSession, [
            partial(winsor_and_medians, coerced, numeric, self.winsorize_quantiles, stored=True),
            partial(E.fit_encoders, labelled, low, high, y)])      # one aggregation for both encoders
        scaler = _moments(coerced, numeric, bounds, medians)
        names = numeric + [f"{c}_woe" for c in low] + [f"{c}_te" for c in high]
        return FeatureModel(numeric, low, high, bounds, medians, scaler, woe, te, self.use_velocity,
                            self.use_graph, self.link_keys, names, edges)


def standard_scale(df: DataFrame, scaler: dict, cols: list[str]) -> DataFrame:
    """F8 applied: (x - mean) / population std (std 0 -> 1)."""
    return df.select(*[c for c in df.columns if c not in cols],
                     *[((F.col(c) - F.lit(scaler[c][0] or 0.0)) /
                        F.lit(scaler[c][1] if scaler[c][1] else 1.0)).alias(c) for c in cols])
