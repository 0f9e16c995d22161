"""Training, cross-validation and search.

The driver loops over models; every fit is distributed. Features are fitted once per fold and shared by
all models and parameter settings, never on rows that are held out.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tabkit.functions.kinds import as_double, col
from tabkit.operators.compare import main_metric
from tabkit.operators.evaluate import classification_metrics, regression_metrics
from tabkit.operators.split import assign_folds, assign_split, with_target
from tabkit.operators.target import CLASSIFICATION, analyze_target
from tabkit.plans.features import FEATURES, MAX_CATEGORIES, check_categories, feature_columns, feature_names, feature_stages
from tabkit.plans.folds import fold_pipelines
from tabkit.plans.models import NamedEstimator, combinations, get_estimator, param_grid, sample_combinations
from tabkit.session import use_all_cores

RUNS_SCHEMA = (
    "experiment string, run_id string, model string, problem_type string, training_time_s double, "
    "cv_mean double, cv_std double, cv_scores array<double>, metrics map<string, double>"
)
FOLDS_BY_MODEL = {"XGBoost": 3}
LABEL = "label"
IS_TEST = "_is_test"
_SCORED = [LABEL, "prediction"]


@dataclass
class Trained:
    """A fitted pipeline with what is needed to apply it."""

    name: str
    problem_type: str
    target: str
    pipeline: PipelineModel
    classes: list[str] | None
    run: dict[str, Any]

    @property
    def model(self):
        return next(s for s in reversed(self.pipeline.stages) if not isinstance(s, IndexToString))


@dataclass
class Training:
    """All models of one training call, the table of runs, the scored test rows of each model (key, target and features),
    and the rows of both sides with all their columns."""

    runs: DataFrame
    models: dict[str, Trained]
    scored: dict[str, DataFrame]
    train: DataFrame
    test: DataFrame
    cached: DataFrame

    def release(self) -> None:
        """Free the cached rows once train, test and scored tables are no longer read."""
        self.cached.unpersist()


def detect_problem(df: DataFrame, target: str) -> str:
    row = analyze_target(df, target).first()
    if row["error"]:
        raise ValueError(row["error"])
    return row["problem_type"]


def with_label(
    df: DataFrame, target: str, problem_type: str, max_categories: int = MAX_CATEGORIES
) -> tuple[DataFrame, list[str] | None]:
    """Add the numeric label; classes are coded in sorted order over all rows with a target."""
    rows = with_target(df, target)
    if problem_type != CLASSIFICATION:
        return rows.withColumn(LABEL, as_double(target)), None
    check_categories(rows, [target], max_categories)
    text = rows.withColumn("_target", col(target).cast("string"))
    indexer = StringIndexer(inputCol="_target", outputCol=LABEL, stringOrderType="alphabetAsc").fit(text)
    return indexer.transform(text).drop("_target"), list(indexer.labels)


def metrics_of(scored: DataFrame, problem_type: str) -> dict[str, float]:
    summary = classification_metrics if problem_type == CLASSIFICATION else regression_metrics
    return summary(scored.select(*_SCORED)).first().asDict()


def _parallel(task: Callable, items: Sequence, parallelism: int) -> list:
    if parallelism <= 1:
        return [task(item) for item in items]
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(task), items)


def fold_scores(
    estimators: Sequence[NamedEstimator], stages: Sequence, folded: DataFrame, k: int, problem_type: str,
    parallelism: int = 1, fold: str = "fold",
) -> list[list[float]]:
    """Accuracy or R2 per estimator and fold. ``folded`` has the label and the fold number."""
    scores: list[list[float]] = [[] for _ in estimators]
    metric = main_metric(problem_type)
    pipelines = fold_pipelines(stages, folded, k, fold)
    for f in range(k):
        fit_rows, held = folded.where(F.col(fold) != f), folded.where(F.col(fold) == f)
        features = pipelines[f] if pipelines else Pipeline(stages=list(stages)).fit(fit_rows)
        fit_rows = use_all_cores(features.transform(fit_rows).select(FEATURES, LABEL)).persist()
        held = features.transform(held).select(FEATURES, LABEL).persist()

        def one(estimator: NamedEstimator, fit_rows=fit_rows, held=held) -> float:
            return metrics_of(estimator.fit(fit_rows).transform(held), problem_type)[metric]

        for i, value in enumerate(_parallel(one, estimators, parallelism)):
            scores[i].append(value)
        fit_rows.unpersist()
        held.unpersist()
    return scores


def cross_validate(
    estimator: NamedEstimator, stages: Sequence, train: DataFrame, key: str | Sequence[str], problem_type: str,
    k: int = 5, seed: int = 42,
) -> dict[str, Any]:
    """Real fold scores with their mean and population standard deviation."""
    stratify = LABEL if problem_type == CLASSIFICATION else None
    folded = assign_folds(train, key, k, seed, stratify).persist()
    try:
        scores = fold_scores([estimator], stages, folded, k, problem_type)[0]
    finally:
        folded.unpersist()
    return {"cv_scores": scores, "cv_mean": float(np.mean(scores)), "cv_std": float(np.std(scores))}


def train(
    df: DataFrame,
    target: str,
    key: str | Sequence[str],
    models: Sequence[str],
    problem_type: str | None = None,
    test_frac: float = 0.2,
    seed: int = 42,
    folds: int | None = 5,
    folds_by_model: dict[str, int] = FOLDS_BY_MODEL,
    experiment: str = "default",
    params: dict[str, dict[str, Any]] | None = None,
    exclude: Sequence[str] = (),
    parallelism: int = 1,
    max_categories: int = MAX_CATEGORIES,
    passthrough_timestamps: bool = False,
    cache: bool = True,
) -> Training:
    """Split, fit every model, evaluate on the test rows, cross-validate on the training rows.

    ``key`` identifies rows: it decides their place in the split and is not a feature. ``folds=None`` skips
    cross-validation; ``folds_by_model`` names models with a number of folds of their own, where that is the
    smaller one: three for boosted trees unless told otherwise. ``passthrough_timestamps`` makes timestamps features. ``cache=False`` reads the source again for every pass
    instead of keeping its rows; the feature vectors a model iterates over are always kept while it is fitted.
    """
    spark = df.sparkSession
    key = [key] if isinstance(key, str) else list(key)
    problem_type = problem_type or detect_problem(df, target)
    labelled, classes = with_label(df, target, problem_type, max_categories)
    stratify = LABEL if problem_type == CLASSIFICATION else None
    marked = assign_split(labelled, key, test_frac, seed, stratify, name=IS_TEST)
    options = {"max_categories": max_categories, "passthrough_timestamps": passthrough_timestamps}
    used = set(feature_columns(labelled, target, [*key, LABEL, *exclude], passthrough_timestamps)) | {*key, target, LABEL, IS_TEST}
    cached = marked.select(*[col(c) for c in marked.columns if c in used])
    if cache:
        cached = cached.persist()
    train_rows, test_rows = (cached.where(side).drop(IS_TEST) for side in (~F.col(IS_TEST), F.col(IS_TEST)))
    stages = feature_stages(train_rows, target, [*key, LABEL, *exclude], **options)
    estimators = {}
    for name in models:
        estimator = get_estimator(name, problem_type, **(params or {}).get(name, {}))
        if estimator is None:
            raise ValueError(f"no model {name!r} for {problem_type}")
        estimators[name] = estimator

    started = time.time()
    features = Pipeline(stages=stages).fit(train_rows)
    vectors = use_all_cores(features.transform(train_rows).select(FEATURES, LABEL)).persist()
    vectors.count()
    preparation = time.time() - started
    trained, scored, rows = {}, {}, []
    decode = [IndexToString(inputCol="prediction", outputCol="predicted_class", labels=classes)] if classes else []
    for name, estimator in estimators.items():
        started = time.time()
        fitted = estimator.fit(vectors)
        seconds = time.time() - started + preparation
        pipeline = PipelineModel([*features.stages, fitted, *decode])
        scored[name] = pipeline.transform(test_rows)
        metrics = metrics_of(scored[name], problem_type)
        run = {
            "experiment": experiment, "run_id": f"{experiment}/{name}", "model": name, "problem_type": problem_type,
            "training_time_s": seconds, "cv_mean": None, "cv_std": None, "cv_scores": None, "metrics": metrics,
        }
        trained[name] = Trained(name, problem_type, target, pipeline, classes, run)
        rows.append(run)
    vectors.unpersist()

    if folds:
        by_k: dict[int, list[str]] = {}
        for name in estimators:
            by_k.setdefault(min(folds, folds_by_model.get(name, folds)), []).append(name)
        for k, names in by_k.items():
            folded = assign_folds(train_rows, key, k, seed, stratify).persist()
            found = fold_scores([estimators[n] for n in names], stages, folded, k, problem_type, parallelism)
            folded.unpersist()
            for name, scores in zip(names, found):
                trained[name].run.update(cv_scores=scores, cv_mean=float(np.mean(scores)), cv_std=float(np.std(scores)))
    runs = spark.createDataFrame([tuple(r[c.split()[0]] for c in _run_columns()) for r in rows], RUNS_SCHEMA)
    whole = [marked.where(side).drop(IS_TEST) for side in (~F.col(IS_TEST), F.col(IS_TEST))]
    return Training(runs, trained, scored, *whole, cached)


def _run_columns() -> list[str]:
    return ["experiment", "run_id", "model", "problem_type", "training_time_s", "cv_mean", "cv_std", "cv_scores", "metrics"]


def search(
    df: DataFrame,
    target: str,
    key: str | Sequence[str],
    model: str,
    problem_type: str | None = None,
    method: str = "grid",
    n_iter: int = 50,
    folds: int = 5,
    seed: int = 42,
    grid: dict[str, list] | None = None,
    exclude: Sequence[str] = (),
    parallelism: int = 2,
    max_categories: int = MAX_CATEGORIES,
    passthrough_timestamps: bool = False,
) -> DataFrame:
    """Cross-validated search over parameter settings: one row per setting, the best first.

    ``method="grid"`` tries all combinations, ``"random"`` a seeded choice of ``n_iter`` of them.
    """
    if not 3 <= folds <= 10:
        raise ValueError("folds must lie between 3 and 10")
    key = [key] if isinstance(key, str) else list(key)
    problem_type = problem_type or detect_problem(df, target)
    grid = grid if grid is not None else param_grid(model, problem_type)
    settings = combinations(grid) if method == "grid" else sample_combinations(grid, n_iter, seed)
    labelled, _ = with_label(df, target, problem_type, max_categories)
    options = {"max_categories": max_categories, "passthrough_timestamps": passthrough_timestamps}
    stages = feature_stages(labelled, target, [*key, LABEL, *exclude], **options)
    stratify = LABEL if problem_type == CLASSIFICATION else None
    folded = assign_folds(labelled, key, folds, seed, stratify).persist()
    estimators = [NamedEstimator(model, problem_type, **s) for s in settings]
    scores = fold_scores(estimators, stages, folded, folds, problem_type, parallelism)
    folded.unpersist()
    rows = [
        (model, {k: str(v) for k, v in s.items()}, float(np.mean(v)), float(np.std(v)), [float(x) for x in v])
        for s, v in zip(settings, scores)
    ]
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][2], i))
    ranked = [(rank + 1, *rows[i]) for rank, i in enumerate(order)]
    return df.sparkSession.createDataFrame(
        ranked,
        "rank int, model string, params map<string, string>, cv_mean double, cv_std double, cv_scores array<double>",
    )


def feature_importance(trained: Trained, sample: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most important features of a tree model. ``sample`` is any table the model can score."""
    if not hasattr(trained.model, "featureImportances"):
        raise ValueError(f"{trained.name} has no feature importance")
    names = feature_names(trained.pipeline.transform(sample.limit(0)))
    values = trained.model.featureImportances.toArray()
    rows = sorted(zip(names, (float(v) for v in values)), key=lambda r: (-r[1], r[0]))
    return sample.sparkSession.createDataFrame(rows[:k], "feature string, importance double")


