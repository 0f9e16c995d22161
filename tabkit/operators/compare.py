"""Comparison of training runs.

Input is the table of runs: ``experiment, run_id, model, problem_type, training_time_s, cv_mean, cv_std,
metrics MAP<STRING, DOUBLE>``; one session of the user is one experiment. Maxima and means per experiment
are aggregates joined back, not windows, so a large experiment is combined before it is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.functions.ranking import attach, rank_within
from tabkit.functions.rules import findings
from tabkit.operators.target import CLASSIFICATION, REGRESSION

METRICS = {
    CLASSIFICATION: ["accuracy", "precision", "recall", "f1_score"],
    REGRESSION: ["r2_score", "mae", "mse", "rmse"],
}
ERRORS = ("mae", "mse", "rmse")
LOWER_IS_BETTER = (*ERRORS, "cv_std", "training_time_s")


def _metric(name: str) -> Column:
    return F.col("metrics")[name]


def _of(runs: DataFrame, problem_type: str) -> DataFrame:
    return runs.where(F.col("problem_type") == problem_type)


def main_metric(problem_type: str) -> str:
    return METRICS[problem_type][0]


def training_summary(runs: DataFrame, problem_type: str) -> DataFrame:
    """One row per run: time, cross-validation mean and spread, and the four metrics."""
    return _of(runs, problem_type).select(
        "experiment", "model", "training_time_s", "cv_mean", "cv_std",
        *[_metric(m).alias(m) for m in METRICS[problem_type]],
    )


def leaderboard(runs: DataFrame, problem_type: str, one_task_rows: int | None = None) -> DataFrame:
    """Runs ranked by accuracy or R2 in their experiment; the model name breaks ties."""
    limits = {} if one_task_rows is None else {"one_task_rows": one_task_rows}
    summary = training_summary(runs, problem_type)
    ranked = rank_within(summary, ["experiment"], main_metric(problem_type), ["model"], "rank", **limits)
    return ranked.select("experiment", "rank", "model", *[c for c in summary.columns if c not in ("experiment", "model")])


def best_model(runs: DataFrame, problem_type: str) -> DataFrame:
    """The best run of each experiment."""
    score = _metric(main_metric(problem_type))
    best = F.min(F.struct((-score).alias("s"), F.col("model").alias("m"), F.col("cv_mean").alias("c"))).alias("b")
    return _of(runs, problem_type).where(score.isNotNull()).groupBy("experiment").agg(best).select(
        "experiment", F.col("b.m").alias("model"), (-F.col("b.s")).alias("score"), F.col("b.c").alias("cv_mean")
    )


def metrics_long(runs: DataFrame, problem_type: str) -> DataFrame:
    """(experiment, model, metric, value)."""
    names = METRICS[problem_type]
    pairs = [part for m in names for part in (F.lit(m), _metric(m))]
    return _of(runs, problem_type).select("experiment", "model", F.stack(F.lit(len(names)), *pairs).alias("metric", "value"))


def column_winners(runs: DataFrame, problem_type: str) -> DataFrame:
    """Per leaderboard column the best value of the experiment and whether a run has it."""
    names = [*METRICS[problem_type], "cv_mean", "cv_std", "training_time_s"]
    summary = training_summary(runs, problem_type)
    pairs = [part for m in names for part in (F.lit(m), F.col(m).cast("double"))]
    long = summary.select("experiment", "model", F.stack(F.lit(len(names)), *pairs).alias("metric", "value"))
    lowest = F.col("metric").isin(*LOWER_IS_BETTER)
    best = long.groupBy("experiment", "metric").agg(F.min("value").alias("low"), F.max("value").alias("high")).select(
        "experiment", "metric", F.when(lowest, F.col("low")).otherwise(F.col("high")).alias("best")
    )
    return attach(long, best, ["experiment", "metric"], ["best"]).select(
        "experiment", "model", "metric", "value", (F.col("value") == F.col("best")).alias("is_best")
    )


def radar_scores(runs: DataFrame, problem_type: str) -> DataFrame:
    """Five axes per run, higher is better: errors become ``1 - value / largest value of the experiment``."""
    names = METRICS[problem_type]
    summary = training_summary(runs, problem_type)
    errors = [m for m in names if m in ERRORS]
    if errors:
        largest = summary.groupBy("experiment").agg(*[F.max(m).alias(f"max_{m}") for m in errors])
        summary = attach(summary, largest, ["experiment"], [f"max_{m}" for m in errors])
    axes = [(F.lit(1.0) - F.try_divide(F.col(m), F.col(f"max_{m}"))).alias(m) if m in errors else F.col(m) for m in names]
    return summary.select("experiment", "model", *axes, F.col("cv_mean").alias("cv_score"))


def use_case_winners(runs: DataFrame, problem_type: str) -> DataFrame:
    """Best score, fastest training and lowest cross-validation spread per experiment."""
    score = _metric(main_metric(problem_type))

    def best(key: Column, value: Column, name: str) -> Column:
        return F.min(F.when(key.isNotNull(), F.struct(key.alias("k"), F.col("model").alias("m"), value.alias("v")))).alias(name)

    found = _of(runs, problem_type).groupBy("experiment").agg(
        best(-score, score, "best_performance"),
        best(F.col("training_time_s"), F.col("training_time_s"), "fastest"),
        best(F.col("cv_std"), F.col("cv_std"), "most_stable"),
    )
    cases = ("best_performance", "fastest", "most_stable")
    pairs = [part for c in cases for part in (F.lit(c), F.col(f"{c}.m"), F.col(f"{c}.v"))]
    return found.select("experiment", F.stack(F.lit(len(cases)), *pairs).alias("use_case", "model", "value"))


def tradeoffs(runs: DataFrame, problem_type: str) -> DataFrame:
    """Points of the two trade-off charts: score over time, F1 (or R2) over spread."""
    score = _metric(main_metric(problem_type))
    second = _metric("f1_score" if problem_type == CLASSIFICATION else "r2_score")
    points = [
        F.lit("score_vs_time"), F.col("training_time_s"), score,
        F.lit("score_vs_stability"), F.col("cv_std"), second,
    ]
    return _of(runs, problem_type).select("experiment", "model", F.stack(F.lit(2), *points).alias("chart", "x", "y"))


def score_zscores(runs: DataFrame, problem_type: str, digits: int = 4) -> DataFrame:
    """Score, mean, population std and z-score of each run in its experiment; z is 0 without spread."""
    scored = _of(runs, problem_type).select("experiment", "model", _metric(main_metric(problem_type)).alias("score"))
    spread = scored.groupBy("experiment").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    joined = attach(scored, spread, ["experiment"], ["mean", "std"])
    z = F.when(F.col("std") > 0, (F.col("score") - F.col("mean")) / F.col("std")).otherwise(0.0)
    return joined.select(
        "experiment", "model", *[F.round(c, digits).alias(c) for c in ("score", "mean", "std")],
        F.round(z, digits).alias("z_score"),
    )


def run_insights(runs: DataFrame) -> DataFrame:
    """Codes on training time, stability and level of the score."""
    classed = F.col("problem_type") == CLASSIFICATION
    accuracy, r2 = _metric("accuracy"), _metric("r2_score")

    def level(name: str, score: Column, high: float, good: float, applies: Column):
        return [
            (applies & (score > high), {"code": f"excellent_{name}"}),
            (applies & (score > good) & (score <= high), {"code": f"good_{name}"}),
            (applies & (score <= good), {"code": f"low_{name}"}),
        ]

    return findings(
        runs,
        [
            (F.col("training_time_s") > 10, {"code": "slow_training"}),
            (F.col("cv_std") > 0.05, {"code": "unstable"}),
            (F.col("cv_std") <= 0.05, {"code": "consistent"}),
            *level("accuracy", accuracy, 0.9, 0.8, classed),
            *level("r2", r2, 0.8, 0.6, ~classed),
        ],
        keep=["experiment", "model"],
    )
