"""M13 training job, S2 batch scoring, E11/E12 contributions.

``train`` composes the whole chain on any application frame: labels (L) ->
time or stratified split (P1, P3) -> leakage guard (P5) -> feature pipeline fit on train (F) ->
stacked ensemble (M7-M9) -> test metrics per model (E1-E6) -> cost sweep and
optimal threshold (E7/E8) -> drift reference on the training features (D2).

Explanations (E11/E12) of scored requests are additive contributions of the applicant's features
to the ensemble's margin (``explain``). ``contributions`` here are those of any linear model,
``coef_j * (x_j - mean_j)``, computed in-row as an array of structs (no shuffle).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import normalize as N
from ..operators import drift as D
from ..operators import evaluate as E
from ..operators import graph_state as GS
from ..operators import labels as L
from ..operators import scoring as S
from ..operators import split as P
from ..operators import validate as V
from ..sources import io as IO
from ..sources.scratch import materialise, side_by_side, stored_columns
from . import explain as EX
from . import models as M
from .features import FeatureBuilder, FeatureModel, engineer_with_state

MODEL_VERSION = "riskweave-0.2"


@dataclass(frozen=True)
class TrainSettings:
    """What a training job may choose; the defaults are what the registered queries run with."""
    split: str = "time"                    # or "stratified"
    val_size: float = 0.15
    test_size: float = 0.15
    labels: L.LabelRules = field(default_factory=L.LabelRules)
    kinds: tuple = ("xgboost", "lightgbm", "catboost", "isolation_forest", "reconstruction")
    rounds: int = 20                       # boosting rounds; the final models stop early on the validation split
    folds: int = 3
    costs: tuple = (E.COST_FN, E.COST_FP, E.COST_TP, E.COST_TN)
    use_velocity: bool = False
    use_graph: bool = True
    seed: int = 42


@dataclass
class TrainingResult:
    features: FeatureModel
    ensemble: M.Ensemble
    drift: D.DriftReference
    meta_means: dict
    report: DataFrame | None = None        # model, metric, value
    test_scores: DataFrame | None = None   # id, label, <base scores>, score
    sweep: DataFrame | None = None

    def save(self, path: str) -> None:
        """IO6: all that scoring needs; ``load`` gives a result that scores alike (without the training reports)."""
        self.features.save(f"{path}/features")
        self.ensemble.save(f"{path}/ensemble")
        self.drift.save(f"{path}/drift")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TrainingResult":
        ens = M.Ensemble.load(spark, f"{path}/ensemble")
        return TrainingResult(FeatureModel.load(spark, f"{path}/features"), ens,
                              D.DriftReference.load(spark, f"{path}/drift"), ens.oof_means)


def applications_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """IO1 and N1-N5: a raw export -> the typed application frame."""
    return IO.typed_applications(N.normalise(IO.read_raw_csv(spark, path)))


def labelled_frame(apps: DataFrame, settings: TrainSettings) -> DataFrame:
    """The applications with ``label`` (L1-L5 unless the frame brings its own) and an instalment, written once.

    Dealt by id: a small input is scanned by one task or two, and so would be every table derived from it."""
    if "installment" not in apps.columns:
        apps = apps.withColumn("installment", N.installment("loan_amnt", "int_rate", "term"))
    if "label" not in apps.columns:
        apps = L.build_fraud_labels(apps, settings.labels).withColumnRenamed("is_fraud", "label")
    return materialise(apps.repartition("id"), "labelled")


def split_frame(lab: DataFrame, settings: TrainSettings) -> DataFrame:
    if settings.split == "time":
        return P.time_split(lab, val_size=settings.val_size, test_size=settings.test_size)
    if settings.split == "stratified":
        return P.stratified_split(lab, "label", settings.val_size, settings.test_size, settings.seed)
    raise ValueError(f"unknown split {settings.split!r}")


def features_with_label(fm: FeatureModel, df: DataFrame, eng: DataFrame) -> DataFrame:
    """The features of ``df``, whose F10 columns ``eng`` has, with its label."""
    x = fm.transform(eng, engineered=True)
    return M.assemble(materialise(x.join(df.select("id", "label"), "id"), "features"), fm.feature_names)


def model_report(scored: DataFrame, name: str) -> DataFrame:
    """E1-E6 of one base model's test scores, or of the ensemble's."""
    return IO.metric_rows(E.binary_metrics(E.scored_pairs(scored, "label", "score" if name == "ensemble" else name)), name)


def train(apps: DataFrame, settings: TrainSettings = TrainSettings()) -> TrainingResult:
    """M13 on any application frame (``applications_from_csv`` reads one from a raw export)."""
    split = split_frame(labelled_frame(apps, settings), settings)
    # leakage guard: rule and outcome columns go; the label stays as the fit target only
    keep = P.drop_leakage(split.drop("score"))
    parts = {s: keep.where(F.col("split") == s) for s in ("train", "val", "test")}
    spark, builder = apps.sparkSession, FeatureBuilder(use_velocity=settings.use_velocity, use_graph=settings.use_graph)
    # each part is engineered once, within itself; the fit reads what the training part's own features are made of
    eng = side_by_side(spark, [partial(builder.engineer, p) for p in parts.values()])
    fm = builder.fit_engineered(*eng[0], y="label")
    xtr, xva, xte = side_by_side(spark, [partial(features_with_label, fm, p, e) for p, (e, _) in zip(parts.values(), eng)])

    # the drift reference needs the training features only
    ens, drift = side_by_side(spark, [
        partial(M.fit_ensemble, xtr, xva, list(settings.kinds), settings.folds, settings.rounds, settings.seed),
        partial(D.fit_reference, stored_columns(xtr, fm.feature_names), fm.feature_names)])
    scored = materialise(ens.score(xte).select("id", "label", *ens.names, "meta_score", "score"), "test-scores")

    *reports, sweep = side_by_side(spark, [
        *[partial(model_report, scored, name) for name in [*ens.names, "ensemble"]],
        partial(E.cost_sweep, E.scored_pairs(scored, "label", "score"), *settings.costs)])
    report = reports[0]
    for r in reports[1:]:
        report = report.unionByName(r)
    return TrainingResult(fm, ens, drift, ens.oof_means, report, scored, sweep)


# ---------------------------------------------------------------- E11 / E12

def contributions(names: list[str], coefs: list[float], means: dict) -> Column:
    """array<struct<feature, value, contribution, direction>> of coef * (x - mean)."""
    items = []
    for n, c in zip(names, coefs):
        contrib = F.lit(float(c)) * (F.col(n) - F.lit(float(means.get(n) or 0.0)))
        items.append(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"),
                              contrib.alias("contribution"),
                              F.when(contrib > 0, "up fraud").otherwise("down fraud").alias("direction")))
    return F.array(*items)


def reason_codes(df: DataFrame, names, coefs, means, top_k: int = 5) -> DataFrame:
    """Top-k contributions by absolute value, in-row (array_sort + slice)."""
    arr = contributions(list(names), list(coefs), means)
    ordered = F.array_sort(arr, lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1)
                           .when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1).otherwise(0))
    return df.withColumn("reason_codes", F.slice(ordered, 1, top_k))


def global_importance(df: DataFrame, names, coefs, means, top: int = 20) -> DataFrame:
    """Mean absolute contribution per input, top ``top``."""
    stacked = F.explode(contributions(list(names), list(coefs), means)).alias("c")
    return (df.select(stacked).groupBy(F.col("c.feature").alias("feature"))
            .agg(F.avg(F.abs("c.contribution")).alias("mean_abs_contribution"))
            .orderBy(F.desc("mean_abs_contribution"), "feature").limit(top))


# ---------------------------------------------------------------- S2

def gate(requests: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """(accepted requests with defaults and a parsed date, violations of the quarantined ones)."""
    if "issue_d" in requests.columns and isinstance(requests.schema["issue_d"].dataType, StringType):
        requests = requests.withColumn("issue_d", N.parse_request_date(F.col("issue_d"), today))
    elif "issue_d" not in requests.columns:
        requests = requests.withColumn("issue_d", F.to_date(F.lit(today)))
    requests = materialise(requests, "requests")
    return V.validate_requests(requests, whole=True)


def score_batch(result: TrainingResult, requests: DataFrame, scored_at: str, review: float = S.REVIEW_THRESHOLD,
                decline: float = S.DECLINE_THRESHOLD, velocity_state: DataFrame | None = None,
                quarantine_dir: str | None = None, graph_state: GS.GraphState | None = None,
                kept: Callable[[DataFrame, GS.GraphUpdate | None], None] | None = None) -> DataFrame:
    """Requests -> contract gate -> features -> ensemble -> decision -> reason codes -> response rows.

    The reason codes are the five features with the largest contributions (E12).

    With ``quarantine_dir`` the request contract (V3) and the request date (N6)
    apply first: rows that break it are not scored, their violations are
    written there. Bucket features are computed within the batch, as the reference
    computes them within the frame it is given; so are graph and velocity features, unless
    the stored state of earlier rows is given. ``kept`` receives the accepted requests and what they add
    to the graph state, for callers that keep state from batch to batch.
    """
    if quarantine_dir is not None:
        requests, broken = gate(requests, scored_at[:10])
        broken.write.mode("overwrite").parquet(quarantine_dir)
    engineered, update = engineer_with_state(result.features, requests, velocity_state, graph_state)
    if kept is not None:
        kept(requests, update)
    x = M.assemble(result.features.transform(engineered, engineered=True), result.features.feature_names)
    names = result.features.feature_names
    s = EX.margin_parts(result.ensemble.score(x), result.ensemble).withColumn("reason_codes", EX.reasons(names))
    return (S.band(s, "score", review, decline)
            .select(F.col("id").alias("application_id"), "fraud_score", "decision", "threshold_review",
                    "threshold_decline", "reason_codes", F.lit(MODEL_VERSION).alias("model_version"),
                    F.to_timestamp(F.lit(scored_at)).alias("scored_at")))
