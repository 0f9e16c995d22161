"""Kernel machines on random Fourier features, of which no expanded row is stored.

Training sums over the rows as they were given and expands each block inside the task that reads it (``tabkit.plans.epsilon``);
the classes of a classifier share every pass. Scoring expands a batch, multiplies it and hands back the margins only.
"""

from __future__ import annotations

from itertools import batched

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.plans.epsilon import TASK_CELLS, Loss, Start, Waves, fitted

COMPONENTS = 128
SEED = 42


class _FourierParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column", TypeConverters.toString)
    rawPredictionCol = Param(Params._dummy(), "rawPredictionCol", "margins by class", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for regression", TypeConverters.toInt)
    C = Param(Params._dummy(), "C", "inverse penalty", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "error of a regression that costs nothing", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    width = Param(Params._dummy(), "width", "entries of the vector", TypeConverters.toInt)
    components = Param(Params._dummy(), "components", "random features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)
    gap = Param(Params._dummy(), "gap", "relative distance to the least objective", TypeConverters.toFloat)
    taskCells = Param(Params._dummy(), "taskCells", "numbers that one task may fit", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(
            featuresCol="features", labelCol="label", predictionCol="prediction", rawPredictionCol="rawPrediction", classes=0, C=1.0,
            epsilon=0.1, gamma=1.0, components=COMPONENTS, seed=SEED, gap=1e-3, taskCells=TASK_CELLS,
        )

    def get(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def _waves(self) -> Waves:
        return Waves.drawn(self.get("gamma"), self.get("width"), self.get("components"), self.get("seed"))


class FourierMachine(Estimator, _FourierParams, DefaultParamsReadable, DefaultParamsWritable):
    """Hinge loss for two classes, one machine per class for more, epsilon-insensitive loss for none."""

    def __init__(self, **params) -> None:
        super().__init__()
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> FourierModel:
        label, classes = F.col(self.get("labelCol")).cast("double"), self.get("classes")
        targets = None if not classes else [1.0] if classes <= 2 else [float(k) for k in range(classes)]
        if targets is None:
            n, mean, deviation, total = dataset.agg(F.count(F.lit(1)), F.avg(label), F.stddev_pop(label), F.sum(F.abs(label))).first()
            starts = [Start(mean or 0.0, max(deviation or 0.0, 1e-6), total or 0.0)]
        else:
            n, *counts = dataset.agg(F.count(F.lit(1)), *[F.count_if(label == t) for t in targets]).first()
            starts = [Start(2 * count / n - 1 if n else 0.0, 4.0, float(n)) for count in counts]
        found = fitted(
            dataset, self.get("featuresCol"), self.get("labelCol"), starts, self.get("C"), Loss(self.get("epsilon") if targets is None else 0.0, targets),
            self.get("gap"), self.get("taskCells"), n, self._waves(),
        )
        model = FourierModel()
        names = ("featuresCol", "predictionCol", "rawPredictionCol", "classes", "C", "epsilon", "gamma", "width", "components", "seed")
        model._set(**{name: self.get(name) for name in names})
        weights = np.concatenate([w for w, _, _ in found]).tolist()
        return model._set(weights=weights, objectives=[float(b) for _, b, _ in found], bounds=[float(b) for _, _, b in found])


class FourierModel(Model, _FourierParams, DefaultParamsReadable, DefaultParamsWritable):
    """Weights and offset of every machine, with the objective that it reaches and a bound that none falls below."""

    weights = Param(Params._dummy(), "weights", "weights and offset by machine", TypeConverters.toListFloat)
    objectives = Param(Params._dummy(), "objectives", "objective by machine", TypeConverters.toListFloat)
    bounds = Param(Params._dummy(), "bounds", "lower bound of the objective by machine", TypeConverters.toListFloat)

    @property
    def models(self) -> list[np.ndarray]:
        """Weights and offset of each machine."""
        return [np.array(part) for part in batched(self.get("weights"), self.get("components") + 1)]

    @property
    def coefficients(self) -> DenseVector:
        if self.get("classes") > 2:
            raise AttributeError("several machines have no common coefficients")
        return DenseVector(self.models[0][:-1])

    @property
    def intercept(self) -> float:
        return float(self.models[0][-1])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        waves, weights, classes = self._waves(), np.column_stack(self.models), self.get("classes")

        @F.pandas_udf("array<double>")
        def margins(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(waves.of(np.stack(x.to_numpy())) @ weights[:-1] + weights[-1]))

        found = margins(vector_to_array(F.col(self.get("featuresCol"))))
        prediction, raw = self.get("predictionCol"), self.get("rawPredictionCol")
        if not classes:
            return dataset.withColumn(prediction, found[0])
        told = dataset.withColumn("_margins", found)
        each = F.array(-F.col("_margins")[0], F.col("_margins")[0]) if classes <= 2 else F.col("_margins")
        best = (F.col("_margins")[0] > 0).cast("double") if classes <= 2 else F.array_position("_margins", F.array_max("_margins")).cast("double") - 1
        return told.withColumn(raw, array_to_vector(each)).withColumn(prediction, best).drop("_margins")
