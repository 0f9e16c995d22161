"""Reports as long tables ``(section, item, value)``: easy to write as Parquet, JSON or CSV."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.operators import compare as K
from tabkit.operators import profile as P


def _section(df: DataFrame, section: str, item: Column, value: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("string").alias("value"))


def _stacked(df: DataFrame, section: str, columns: list[str]) -> DataFrame:
    pairs = [part for c in columns for part in (F.lit(c), F.col(c).cast("string"))]
    return df.select(F.lit(section).alias("section"), F.stack(F.lit(len(columns)), *pairs).alias("item", "value"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def eda_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """Overview, missing values and insights of a table."""
    missing = P.missing_summary(df)
    insight = P.insights(df, target)
    return _union(
        [
            _stacked(P.table_overview(df), "overview", ["n_rows", "n_columns", "columns_with_missing"]),
            _section(missing, "missing_values", F.col("column_name"), F.col("missing_count")),
            _section(insight, "insights", F.col("code"), F.round("value", 4)),
        ]
    )


def evaluation_report(runs: DataFrame, problem_type: str) -> DataFrame:
    """Metrics, time and cross-validation result of every run."""
    names = [*K.METRICS[problem_type], "training_time_s", "cv_mean", "cv_std"]
    summary = K.training_summary(runs, problem_type)
    pairs = [part for m in names for part in (F.lit(m), F.col(m).cast("double"))]
    long = summary.select("experiment", "model", F.stack(F.lit(len(names)), *pairs).alias("metric", "value"))
    return _section(long, "metrics", F.concat_ws("/", "experiment", "model", "metric"), F.round("value", 4))


def comparison_report(runs: DataFrame, problem_type: str) -> DataFrame:
    """The leaderboard and the winner of each use case."""
    board, winners = K.leaderboard(runs, problem_type), K.use_case_winners(runs, problem_type)
    return _union(
        [
            _section(board, "leaderboard", F.concat_ws("/", "experiment", F.col("rank").cast("string")), F.col("model")),
            _section(winners, "recommendations", F.concat_ws("/", "experiment", "use_case"), F.col("model")),
        ]
    )


def write_report(report: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    report.write.mode(mode).format(fmt).save(path)
