"""F9 and M7-M10 as ``pyspark.ml`` stages, so one ``PipelineModel`` holds features, ensemble and calibration.

``FeatureEngineering`` fits the feature pipeline and adds the feature columns and their vector; ``StackedEnsemble``
fits base models, meta-learner and calibration on that vector and adds the base scores, ``meta_score`` and ``score``.
A fitted pipeline is written and read with the usual ``write().overwrite().save(path)`` and
``PipelineModel.load(path)``; the folders below a stage are those of IO6.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from . import models as M
from .features import FeatureBuilder, FeatureModel


class _StateWriter(MLWriter):
    """Params as the default writer writes them, the fitted state in the folder ``state``."""

    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.fitted.save(f"{path}/state")


class _StateReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        instance = self.cls(self.cls.STATE.load(self.sparkSession, f"{path}/state"))
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        return instance


class _Fitted(Model, MLWritable, MLReadable):
    """A model around a fitted object with ``save(path)`` and ``load(spark, path)``."""

    STATE: type

    def __init__(self, fitted):
        super().__init__()
        self.fitted = fitted

    def write(self) -> MLWriter:
        return _StateWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StateReader(cls)


class _Columns(Params):
    idCol = Param(Params._dummy(), "idCol", "unique row id", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "0/1 label", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(idCol="id", labelCol="label", featuresCol="features")

    def _columns(self) -> tuple[str, str, str]:
        return self.getOrDefault(self.idCol), self.getOrDefault(self.labelCol), self.getOrDefault(self.featuresCol)


class FeatureEngineeringModel(_Fitted, _Columns):
    """Adds the fitted features (F9) and their vector; of the input only id and, if there, label stay."""

    STATE = FeatureModel

    def _transform(self, dataset: DataFrame) -> DataFrame:
        id_col, label, vector = self._columns()
        x = self.fitted.transform(dataset, id_col)
        if label in dataset.columns:
            x = x.join(dataset.select(id_col, label), id_col)
        return M.assemble(x, self.fitted.feature_names, vector)


class FeatureEngineering(Estimator, _Columns, DefaultParamsWritable, DefaultParamsReadable):
    useVelocity = Param(Params._dummy(), "useVelocity", "add W1 counts", TypeConverters.toBoolean)
    useGraph = Param(Params._dummy(), "useGraph", "add GR features", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, idCol="id", labelCol="label", featuresCol="features", useVelocity=False, useGraph=True):
        super().__init__()
        self._setDefault(useVelocity=False, useGraph=True)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> FeatureEngineeringModel:
        id_col, label, _ = self._columns()
        builder = FeatureBuilder(use_velocity=self.getOrDefault(self.useVelocity), use_graph=self.getOrDefault(self.useGraph))
        return self._copyValues(FeatureEngineeringModel(builder.fit(dataset, y=label, id_col=id_col)))


class StackedEnsembleModel(_Fitted, _Columns):
    """Base scores, ``meta_score`` and the calibrated ``score``."""

    STATE = M.Ensemble

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.score(dataset, self._columns()[2])


class StackedEnsemble(Estimator, _Columns, DefaultParamsWritable, DefaultParamsReadable):
    """M7-M9: out-of-fold scores, meta-learner, final base models and isotonic calibration.

    ``validationShare`` of the rows, chosen by a hash of the id, are kept for early stopping and calibration.
    """
    kinds = Param(Params._dummy(), "kinds", "base models", TypeConverters.toListString)
    folds = Param(Params._dummy(), "folds", "out-of-fold parts", TypeConverters.toInt)
    rounds = Param(Params._dummy(), "rounds", "boosting rounds", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)
    validationShare = Param(Params._dummy(), "validationShare", "rows for calibration", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, idCol="id", labelCol="label", featuresCol="features", kinds=None, folds=3, rounds=20, seed=42,
                 validationShare=0.2):
        super().__init__()
        self._setDefault(kinds=[*M.GBT_PRESETS, "isolation_forest", "reconstruction"], folds=3, rounds=20, seed=42, validationShare=0.2)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> StackedEnsembleModel:
        id_col, label, vector = self._columns()
        rows = materialise(dataset.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("features")), "stack-input")
        get = self.getOrDefault
        held = F.pmod(F.xxhash64(F.col("id"), F.lit(get(self.seed))), F.lit(1 << 30)) < int(get(self.validationShare) * (1 << 30))
        fitted = M.fit_ensemble(rows.where(~held), rows.where(held), get(self.kinds), get(self.folds), get(self.rounds), get(self.seed))
        return self._copyValues(StackedEnsembleModel(fitted))


def scoring_pipeline(kinds=None, rounds: int = 20, folds: int = 3, use_velocity: bool = False, use_graph: bool = True,
                     seed: int = 42) -> Pipeline:
    """Labelled applications -> calibrated scores, as one pipeline."""
    return Pipeline(stages=[FeatureEngineering(useVelocity=use_velocity, useGraph=use_graph),
                            StackedEnsemble(kinds=kinds, folds=folds, rounds=rounds, seed=seed)])


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
