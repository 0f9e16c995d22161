"""The trainable models by name, with the parameter names and defaults their users know.

Spark's linear models divide the loss by the number of rows and, for squared loss, work on a label scaled
to unit deviation, so a penalty such as ``C`` or ``alpha`` has to be translated with facts of the training
rows. ``NamedEstimator`` does that at fit time, which keeps it right inside cross-validation too.

Kernel machines have no Spark counterpart. "Support Vector Machine (SVM)" is a linear SVM on random Fourier
features of the RBF kernel (Rahimi & Recht, 2007), or with ``method="exact"`` the machine itself, by a cascade
(``tabkit.plans.kernels``); "Support Vector Regression (SVR)" has the epsilon-insensitive loss on such features
(``tabkit.plans.fourier``). "XGBoost" is boosting by gradients and hessians (``tabkit.plans.boosting``), with a softmax for
several classes. Forests keep Spark's rules (32 bins, Poisson draws, depth 30) but hold equal binned rows once
(``tabkit.plans.forest``). Scores are close in kind, not equal.
"""

from __future__ import annotations

import itertools
import random
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, LogisticRegression, OneVsRest,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
    MLWritable, MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.operators.knn import CellIndex, elected, votes
from tabkit.operators.target import CLASSIFICATION, REGRESSION
from tabkit.plans.boosting import NewtonBoost
from tabkit.plans.epsilon import EpsilonRegression, Waves
from tabkit.plans.forest import Forest
from tabkit.plans.fourier import FourierMachine
from tabkit.plans.kernels import KernelMachine
from tabkit.session import shared_table

SEED = 42
SPARK_MAX_DEPTH = 30
FOURIER_COMPONENTS = 128

# Defaults of the models. Fixed values.
DEFAULTS: dict[tuple[str, str], dict[str, Any]] = {
    (CLASSIFICATION, "Logistic Regression"): {"C": 1.0, "penalty": "l2"},
    (CLASSIFICATION, "Decision Tree"): {"max_depth": None, "min_samples_leaf": 1, "criterion": "gini"},
    (CLASSIFICATION, "Random Forest"): {"n_estimators": 100, "max_depth": None, "min_samples_leaf": 1},
    (CLASSIFICATION, "Support Vector Machine (SVM)"): {"C": 1.0, "kernel": "rbf", "gamma": "scale", "method": "fourier"},
    (CLASSIFICATION, "K-Nearest Neighbors (KNN)"): {"n_neighbors": 5, "weights": "uniform", "metric": "euclidean"},
    (CLASSIFICATION, "XGBoost"): {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "subsample": 1.0},
    (REGRESSION, "Linear Regression"): {"fit_intercept": True},
    (REGRESSION, "Ridge Regression"): {"alpha": 1.0},
    (REGRESSION, "Lasso Regression"): {"alpha": 0.1},
    (REGRESSION, "Decision Tree"): {"max_depth": 10, "min_samples_leaf": 2},
    (REGRESSION, "Random Forest"): {"n_estimators": 100, "max_depth": 15, "min_samples_leaf": 2},
    (REGRESSION, "Support Vector Regression (SVR)"): {"C": 1.0, "epsilon": 0.1, "kernel": "rbf", "gamma": "scale"},
    (REGRESSION, "XGBoost"): {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "subsample": 1.0},
}

# Search grids. Fixed values; parameters without a Spark counterpart (min_samples_split, solver, selection,
# the poly kernel, regression criteria other than variance) are left out.
_C = [0.1, 1.0, 10.0, 100.0]
_KERNEL = {"C": _C, "kernel": ["rbf", "linear"], "gamma": ["scale", "auto", "0.001", "0.01", "0.1", "1"]}
_TREE = {"max_depth": [3, 5, 7, 10, None], "min_samples_leaf": [1, 2, 4]}
_FOREST = {"n_estimators": [50, 100, 200], "max_depth": [5, 10, 15, None], "min_samples_leaf": [1, 2, 4]}
_BOOST = {
    "n_estimators": [50, 100, 200], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.1, 0.2], "subsample": [0.8, 0.9, 1.0],
}
GRIDS: dict[tuple[str, str], dict[str, list]] = {
    (CLASSIFICATION, "Logistic Regression"): {"C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0], "penalty": ["l1", "l2"]},
    (CLASSIFICATION, "Decision Tree"): {**_TREE, "criterion": ["gini", "entropy"]},
    (CLASSIFICATION, "Random Forest"): _FOREST,
    (CLASSIFICATION, "Support Vector Machine (SVM)"): _KERNEL,
    (CLASSIFICATION, "K-Nearest Neighbors (KNN)"): {
        "n_neighbors": [3, 5, 7, 9, 11], "weights": ["uniform", "distance"], "metric": ["euclidean", "manhattan"],
    },
    (CLASSIFICATION, "XGBoost"): _BOOST,
    (REGRESSION, "Linear Regression"): {"fit_intercept": [True, False]},
    (REGRESSION, "Ridge Regression"): {"alpha": [0.1, 1.0, 10.0, 100.0]},
    (REGRESSION, "Lasso Regression"): {"alpha": [0.1, 1.0, 10.0, 100.0]},
    (REGRESSION, "Decision Tree"): _TREE,
    (REGRESSION, "Random Forest"): _FOREST,
    (REGRESSION, "Support Vector Regression (SVR)"): _KERNEL,
    (REGRESSION, "XGBoost"): _BOOST,
}


def model_names(problem_type: str) -> list[str]:
    return [name for problem, name in DEFAULTS if problem == problem_type]


class _Vectors(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction")

    def get(self, name: str):
        return self.getOrDefault(self.getParam(name))


class FourierFeatures(Transformer, _Vectors, DefaultParamsReadable, DefaultParamsWritable):
    """Random cosine features whose inner products approximate the RBF kernel ``exp(-gamma |x - y|^2)``."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    width = Param(Params._dummy(), "width", "entries of the input vector", TypeConverters.toInt)
    components = Param(Params._dummy(), "components", "random features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)
    outputCol = Param(Params._dummy(), "outputCol", "output column", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(gamma=1.0, components=FOURIER_COMPONENTS, seed=SEED, outputCol="fourier")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        waves = Waves.drawn(self.get("gamma"), self.get("width"), self.get("components"), self.get("seed"))

        @F.pandas_udf("array<double>")
        def cosines(x: pd.Series) -> pd.Series:
            return pd.Series(list(waves.of(np.stack(x.to_numpy()))) if len(x) else [])

        expanded = array_to_vector(cosines(vector_to_array(F.col(self.get("featuresCol")))))
        return dataset.withColumn(self.get("outputCol"), expanded)


class _KnnWriter(MLWriter):
    def __init__(self, model: KnnModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession.sparkContext)
        self.model.index.save(path + "/index")


class _KnnReader(MLReader):
    def load(self, path: str) -> KnnModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession.sparkContext)
        model = KnnModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.index = CellIndex.load(self.sparkSession, path + "/index", model.get("metric"))
        return model


class KnnModel(Model, _Vectors, MLReadable, MLWritable):
    """Keeps the training points as a stored index; scoring is an exact nearest-neighbour search for every different
    row, and the shares of the votes are its probabilities."""

    neighbours = Param(Params._dummy(), "neighbours", "k", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    metric = Param(Params._dummy(), "metric", "euclidean or manhattan", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "probability column", TypeConverters.toString)

    def __init__(self, index: CellIndex | None = None) -> None:
        super().__init__()
        self._setDefault(neighbours=5, weights="uniform", metric="euclidean", classes=0, probabilityCol="probability")
        self.index = index

    def copy(self, extra=None):
        that = super().copy(extra)
        that.index = self.index
        return that

    def write(self) -> MLWriter:
        return _KnnWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _KnnReader()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if dataset.isStreaming:
            raise ValueError("nearest neighbours cannot score a stream; use another model")
        vector = vector_to_array(F.col(self.get("featuresCol")))
        different = dataset.select(vector.alias("vec")).distinct().select(F.xxhash64("vec").alias("qid"), "vec")
        found = elected(votes(self.index.search(shared_table(different, "knn-queries"), self.get("neighbours")), self.get("weights")))
        each = F.transform(F.sequence(F.lit(0), F.lit(self.get("classes") - 1)), lambda c: F.coalesce(F.try_element_at("shares", c.cast("double")), F.lit(0.0)))
        told = found.select(
            F.col("qid").alias("_qid"), F.col("prediction").alias(self.get("predictionCol")), array_to_vector(each).alias(self.get("probabilityCol"))
        )
        return dataset.join(told, F.xxhash64(vector) == F.col("_qid"), "left").drop("_qid")


class NamedEstimator(Estimator, _Vectors, DefaultParamsReadable, DefaultParamsWritable):
    """A model by name. Every parameter keeps its usual name; unset parameters take the model's defaults."""

    name = Param(Params._dummy(), "name", "model name", TypeConverters.toString)
    problemType = Param(Params._dummy(), "problemType", "Classification or Regression", TypeConverters.toString)
    C = Param(Params._dummy(), "C", "inverse penalty", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "l1 or l2", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "penalty", TypeConverters.toFloat)
    fit_intercept = Param(Params._dummy(), "fit_intercept", "intercept", TypeConverters.toBoolean)
    max_depth = Param(Params._dummy(), "max_depth", "tree depth, None for as deep as possible", TypeConverters.identity)
    min_samples_leaf = Param(Params._dummy(), "min_samples_leaf", "rows per leaf", TypeConverters.toInt)
    criterion = Param(Params._dummy(), "criterion", "gini or entropy", TypeConverters.toString)
    n_estimators = Param(Params._dummy(), "n_estimators", "trees", TypeConverters.toInt)
    learning_rate = Param(Params._dummy(), "learning_rate", "shrinkage", TypeConverters.toFloat)
    subsample = Param(Params._dummy(), "subsample", "rows per tree", TypeConverters.toFloat)
    n_neighbors = Param(Params._dummy(), "n_neighbors", "k", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    metric = Param(Params._dummy(), "metric", "euclidean or manhattan", TypeConverters.toString)
    kernel = Param(Params._dummy(), "kernel", "rbf or linear", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "scale, auto or a number", TypeConverters.toString)
    method = Param(Params._dummy(), "method", "fourier or exact", TypeConverters.toString)
    epsilon = Param(Params._dummy(), "epsilon", "error that costs nothing", TypeConverters.toFloat)

    def __init__(self, name: str | None = None, problem_type: str | None = None, **params: Any) -> None:
        super().__init__()
        if name is not None:
            self._set(name=name, problemType=problem_type)
            self._setDefault(**DEFAULTS[(problem_type, name)])
            self._set(**params)

    def get(self, name: str):
        param = self.getParam(name)
        if self.hasDefault(param) or self.isSet(param):
            return self.getOrDefault(param)
        return DEFAULTS[(self.getOrDefault(self.problemType), self.getOrDefault(self.name))][name]

    def _columns(self, features: str | None = None) -> dict[str, str]:
        return {
            "featuresCol": features or self.get("featuresCol"),
            "labelCol": self.get("labelCol"),
            "predictionCol": self.get("predictionCol"),
        }

    def _tree(self) -> dict[str, Any]:
        depth = self.get("max_depth")
        return {
            "maxDepth": SPARK_MAX_DEPTH if depth is None else min(depth, SPARK_MAX_DEPTH),
            "minInstancesPerNode": self.get("min_samples_leaf"), "seed": SEED,
        }

    def _forest(self) -> dict[str, Any]:
        tree = self._tree()
        return {"trees": self.get("n_estimators"), "depth": tree["maxDepth"], "least": tree["minInstancesPerNode"], "seed": SEED}

    def _fit(self, dataset: DataFrame) -> Model:
        problem, name = self.get("problemType"), self.get("name")
        columns = self._columns()
        label = F.col(columns["labelCol"])
        n, top, spread = dataset.agg(F.count(F.lit(1)), F.max(label), F.stddev_pop(label)).first()
        if problem == CLASSIFICATION:
            return self._fit_classifier(dataset, name, columns, n, int(top) + 1)
        return self._fit_regressor(dataset, name, columns, n, spread)

    def _fit_classifier(self, dataset, name, columns, n, classes) -> Model:
        if name == "Logistic Regression":
            estimator = LogisticRegression(
                regParam=1.0 / (self.get("C") * n), elasticNetParam=1.0 if self.get("penalty") == "l1" else 0.0,
                standardization=False, maxIter=1000, **columns,
            )
        elif name == "Decision Tree":
            estimator = DecisionTreeClassifier(impurity=self.get("criterion"), **self._tree(), **columns)
        elif name == "Random Forest":
            estimator = Forest(classes=max(classes, 2), subset="sqrt", **self._forest(), **columns)
        elif name == "Support Vector Machine (SVM)":
            if self.get("kernel") != "linear":
                gamma, width = self._gamma(dataset)
                if self.get("method") == "exact" and self.get("kernel") == "rbf":
                    return KernelMachine(classes=max(classes, 2), C=self.get("C"), gamma=gamma, **columns).fit(dataset)
                return FourierMachine(classes=max(classes, 2), C=self.get("C"), gamma=gamma, width=width, **columns).fit(dataset)
            estimator = LinearSVC(regParam=1.0 / (self.get("C") * n), standardization=False, tol=1e-3, **columns)
            if classes > 2:
                estimator = OneVsRest(classifier=estimator, parallelism=min(classes, 4), **columns)
        elif name == "K-Nearest Neighbors (KNN)":
            points = dataset.select(
                vector_to_array(F.col(columns["featuresCol"])).alias("vec"),
                F.col(columns["labelCol"]).cast("double").alias("label"),
            )
            model = KnnModel(CellIndex.build(points, self.get("metric")))
            return model._set(
                neighbours=self.get("n_neighbors"), weights=self.get("weights"), metric=self.get("metric"), classes=classes,
                featuresCol=columns["featuresCol"], predictionCol=columns["predictionCol"],
            )
        else:
            estimator = NewtonBoost(classes=max(classes, 2), **self._boost(), **columns)
        return estimator.fit(dataset)

    def _fit_regressor(self, dataset, name, columns, n, spread) -> Model:
        if name == "Linear Regression":
            estimator = LinearRegression(fitIntercept=self.get("fit_intercept"), regParam=0.0, **columns)
        elif name == "Ridge Regression":
            estimator = LinearRegression(
                elasticNetParam=0.0, standardization=False, regParam=self.get("alpha") * (spread or 0.0) / n, **columns
            )
        elif name == "Lasso Regression":
            estimator = LinearRegression(
                elasticNetParam=1.0, standardization=False, regParam=self.get("alpha"), maxIter=2000, tol=1e-8, **columns
            )
        elif name == "Decision Tree":
            estimator = DecisionTreeRegressor(**self._tree(), **columns)
        elif name == "Random Forest":
            estimator = Forest(subset="all", **self._forest(), **columns)
        elif name == "Support Vector Regression (SVR)":
            costs = {"C": self.get("C"), "epsilon": self.get("epsilon"), **columns}
            if self.get("kernel") != "linear":
                gamma, width = self._gamma(dataset)
                return FourierMachine(gamma=gamma, width=width, **costs).fit(dataset)
            estimator = EpsilonRegression(**costs)
        else:
            estimator = NewtonBoost(**self._boost(), **columns)
        return estimator.fit(dataset)

    def _boost(self) -> dict[str, Any]:
        return {
            "rounds": self.get("n_estimators"), "depth": self.get("max_depth"), "rate": self.get("learning_rate"),
            "subsample": self.get("subsample"), "seed": SEED,
        }

    def _gamma(self, dataset: DataFrame) -> tuple[float, int]:
        """The kernel's width as a number, and the size of the vectors."""
        features = self.get("featuresCol")
        width = len(dataset.select(features).first()[0])
        gamma = self.get("gamma")
        if gamma == "scale":
            # the variance of all entries from those of the columns
            found = Summarizer.metrics("mean", "variance", "count").summary(F.col(features)).alias("s")
            means, variances, n = dataset.select(found).first()["s"]
            variance = float(np.mean(variances.toArray()) * (n - 1) / n + np.var(means.toArray()))
            gamma = 1.0 / (width * variance) if variance else 1.0
        elif gamma == "auto":
            gamma = 1.0 / width
        return float(gamma), width


def get_estimator(name: str, problem_type: str, **params: Any) -> NamedEstimator | None:
    """The model of that name, or ``None`` when there is none for the problem."""
    if (problem_type, name) not in DEFAULTS:
        return None
    return NamedEstimator(name, problem_type, **params)


def param_grid(name: str, problem_type: str) -> dict[str, list]:
    """Values to search per parameter; empty for an unknown model."""
    return dict(GRIDS.get((problem_type, name), {}))


def combinations(grid: dict[str, list]) -> list[dict[str, Any]]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def sample_combinations(grid: dict[str, list], n_iter: int, seed: int = SEED) -> list[dict[str, Any]]:
    """Up to ``n_iter`` different combinations, drawn without repetition."""
    every = combinations(grid)
    return every if n_iter >= len(every) else random.Random(seed).sample(every, n_iter)


def model_size(model: Any) -> dict[str, int]:
    """Coefficients, features or trees of a fitted model, whichever it has."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if isinstance(last, PipelineModel):
        return model_size(last)
    if hasattr(last, "coefficientMatrix"):
        matrix = last.coefficientMatrix
        return {"coefficients": matrix.numRows * matrix.numCols}
    if hasattr(last, "coefficients"):
        return {"coefficients": last.coefficients.size}
    if hasattr(last, "models"):
        return {"models": len(last.models)}
    if hasattr(last, "support"):
        return {"support_vectors": last.support}
    size = {}
    if hasattr(last, "numFeatures"):
        size["features"] = last.numFeatures
    if hasattr(last, "getNumTrees"):
        trees = last.getNumTrees
        size["trees"] = trees() if callable(trees) else trees
    return size
