"""Model shortlist: score the catalogue of models against the characteristics of many tables at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabkit.functions.kinds import NUMERIC, TEXT, col, kinds
from tabkit.functions.rules import findings
from tabkit.functions.stats import finite_or_null
from tabkit.operators.target import CLASSIFICATION, REGRESSION, is_classification

SUITABILITY_POINTS = {"Low": 1, "Medium": 2, "High": 3, "Very High": 4}

# The catalogue: problem, name, suitability (* depends on the table), complexity, and whether the model's
# description speaks for many features, for categorical features, for missing values. Fixed values.
CATALOGUE = [
    (CLASSIFICATION, "Logistic Regression", "*", "Low", False, False, False),
    (CLASSIFICATION, "Decision Tree", "High", "Low", False, True, False),
    (CLASSIFICATION, "Random Forest", "Very High", "Medium", True, False, True),
    (CLASSIFICATION, "Support Vector Machine (SVM)", "*", "Medium", False, False, False),
    (CLASSIFICATION, "K-Nearest Neighbors (KNN)", "Medium", "Low", False, False, False),
    (CLASSIFICATION, "XGBoost", "Very High", "High", False, False, True),
    (REGRESSION, "Linear Regression", "*", "Low", False, False, False),
    (REGRESSION, "Ridge Regression", "High", "Low", False, False, False),
    (REGRESSION, "Lasso Regression", "High", "Low", True, False, False),
    (REGRESSION, "Decision Tree", "High", "Low", False, False, False),
    (REGRESSION, "Random Forest", "Very High", "Medium", True, False, False),
    (REGRESSION, "Support Vector Regression (SVR)", "Medium", "Medium", False, False, False),
]
_SLOW_ON_LARGE = ("K-Nearest Neighbors (KNN)", "Support Vector Machine (SVM)", "Support Vector Regression (SVR)")
_GOOD_ON_LARGE = ("Random Forest", "XGBoost")


def dataset_characteristics(
    df: DataFrame, target: str, problem_type: str | None = None, table_name: str = "table"
) -> DataFrame:
    """One row of facts about a table and its target: the input of the ranking."""
    target_kind = kinds(df)[target]
    features = {c: k for c, k in kinds(df).items() if c != target}
    cells = [F.count(F.lit(1)) - F.count(col(c)) for c in df.columns]
    x = finite_or_null(target) if target_kind == NUMERIC else F.lit(None).cast("double")
    whole = df.agg(
        F.count(F.lit(1)).alias("n_samples"),
        reduce(lambda a, b: a + b, cells).alias("missing_cells"),
        (F.max(x) - F.min(x)).alias("spread"),
        F.stddev_samp(x).alias("std"),
    ).first()
    per_class = df.where(col(target).isNotNull()).groupBy(col(target)).agg(F.count(F.lit(1)).alias("n"))
    classes = per_class.agg(
        F.count(F.lit(1)).alias("unique"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("non_null"),
        F.try_divide(F.min("n").cast("double"), F.max("n")).alias("balance"),
    )
    is_class = F.lit(problem_type == CLASSIFICATION or target_kind != NUMERIC)
    with_classes = is_class | is_classification(df.schema[target].dataType, F.col("unique"), F.col("non_null"))
    n, missing = F.lit(whole["n_samples"]).cast("long"), F.lit(whole["missing_cells"]).cast("long")
    n_numeric = sum(k == NUMERIC for k in features.values())
    n_text = sum(k == TEXT for k in features.values()) + (target_kind == TEXT)
    return classes.select(
        F.lit(table_name).alias("table_name"),
        F.lit(target).alias("target"),
        F.coalesce(
            F.lit(problem_type), F.when(with_classes, CLASSIFICATION).otherwise(REGRESSION)
        ).alias("problem_type"),
        n.alias("n_samples"),
        F.lit(len(features)).alias("n_features"),
        F.lit(n_numeric).alias("n_numeric_features"),
        F.lit(n_text).alias("n_categorical_features"),
        (missing > 0).alias("has_missing_values"),
        F.round(F.try_divide(F.lit(100.0) * missing, n * len(df.columns)), 6).alias("missing_percentage"),
        F.lit("numeric" if target_kind == NUMERIC else "categorical").alias("target_type"),
        F.when(with_classes, F.col("unique")).alias("n_classes"),
        F.when(with_classes, F.col("unique") == 2).alias("is_binary"),
        F.when(with_classes, F.round("balance", 6)).alias("class_balance"),
        F.when(~is_class, F.round(F.lit(whole["spread"]).cast("double"), 6)).alias("target_range"),
        F.when(~is_class, F.round(F.lit(whole["std"]).cast("double"), 6)).alias("target_std"),
    )


def _suitability() -> Column:
    """The suitability of a catalogue entry, with the three that depend on the table."""
    model = F.col("m.model")
    return (
        F.when(model == "Logistic Regression", F.when(F.coalesce("is_binary", F.lit(False)), "High").otherwise("Medium"))
        .when(model == "Support Vector Machine (SVM)", F.when(F.col("n_samples") < 100_000, "High").otherwise("Medium"))
        .when(model == "Linear Regression", F.when(F.col("n_features") < F.col("n_samples"), "High").otherwise("Medium"))
        .otherwise(F.col("m.suitability"))
    )


def recommend_models(characteristics: DataFrame) -> DataFrame:
    """One row per table and catalogue model of its problem type, with the suitability.

    The catalogue is a literal inside the plan: each row of facts is expanded in place, without a join.
    """
    entries = {CLASSIFICATION: [], REGRESSION: []}
    for problem, name, suitability, complexity, features, categories, missing in CATALOGUE:
        entries[problem].append(
            F.struct(
                F.lit(len(entries[problem]) + 1).alias("position"),
                F.lit(name).alias("model"),
                F.lit(suitability).alias("suitability"),
                F.lit(complexity).alias("complexity"),
                F.lit(features).alias("for_many_features"),
                F.lit(categories).alias("for_categories"),
                F.lit(missing).alias("handles_missing"),
            )
        )
    catalogue = F.when(F.col("problem_type") == CLASSIFICATION, F.array(*entries[CLASSIFICATION])).otherwise(
        F.array(*entries[REGRESSION])
    )
    expanded = characteristics.select("*", F.explode(catalogue).alias("m"))
    return expanded.withColumn("suitability", _suitability()).select(
        *characteristics.columns, "m.position", "m.model", "suitability", "m.complexity",
        "m.for_many_features", "m.for_categories", "m.handles_missing",
    )


def rank_models(characteristics: DataFrame, missing_bonus: bool = False) -> DataFrame:
    """Score and rank the catalogue for every table; equal scores keep the catalogue order.

    ``missing_bonus`` adds ten points to models that cope with missing values when there are any.
    """
    points = F.create_map(*[F.lit(v) for item in SUITABILITY_POINTS.items() for v in item])
    n, features, complexity, model = (F.col(c) for c in ("n_samples", "n_features", "complexity", "model"))
    size = (
        F.when((n < 1000) & (complexity == "Low"), 15)
        .when((n < 1000) & (complexity == "High"), -10)
        .when((n > 100_000) & model.isin(*_SLOW_ON_LARGE), -15)
        .when((n > 100_000) & model.isin(*_GOOD_ON_LARGE), 10)
        .otherwise(0)
    )
    width = (
        F.when((features > 100) & F.col("for_many_features"), 10)
        .when((features > 100) & (model == "K-Nearest Neighbors (KNN)"), -15)
        .otherwise(0)
    )
    gaps = F.when(F.lit(missing_bonus) & F.col("has_missing_values") & F.col("handles_missing"), 10).otherwise(0)
    categories = F.when((F.col("n_categorical_features") > 0) & F.col("for_categories"), 10).otherwise(0)
    scored = recommend_models(characteristics).withColumn(
        "score", points[F.col("suitability")] * 25 + size + width + gaps + categories
    )
    order = Window.partitionBy("table_name", "target").orderBy(F.desc("score"), "position")
    return scored.withColumn("rank", F.row_number().over(order)).select(
        "table_name", "target", "problem_type", "rank", "model", "suitability", "complexity", "score"
    )


def top_models(characteristics: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` models of each table; rank 1 is the default pick."""
    return rank_models(characteristics).where(F.col("rank") <= k).withColumn("is_default", F.col("rank") == 1)


def size_advice(characteristics: DataFrame) -> DataFrame:
    """Advice codes on target range and table size."""
    n = F.col("n_samples")
    return findings(
        characteristics,
        [
            ((F.col("problem_type") == REGRESSION) & (F.col("target_range") > 1000), {"code": "wide_target_range"}),
            (n < 1000, {"code": "small_dataset"}),
            (n > 50_000, {"code": "large_dataset"}),
            (F.col("n_features") > 50, {"code": "high_dimensional"}),
        ],
        keep=["table_name", "target"],
    )
