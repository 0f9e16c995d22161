"""Target analysis: which kind of problem a target column poses, and what its values look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.functions.kinds import NESTED, NUMERIC, as_double, col, kind_of, kinds
from tabkit.functions.quantiles import quantiles
from tabkit.functions.rules import findings, percent
from tabkit.functions.stats import adjusted_kurtosis, adjusted_skewness, finite_or_null, skew_class

CLASSIFICATION = "Classification"
REGRESSION = "Regression"

MAX_CLASS_VALUES = 20
MIN_DISTINCT_SHARE = 0.05

# Models that suit a problem, in the order they are shown. Fixed values.
SUITABLE_MODELS = {
    (CLASSIFICATION, "Binary"): [
        "Logistic Regression", "Decision Tree", "Random Forest", "Support Vector Machine (SVM)",
        "K-Nearest Neighbors (KNN)", "XGBoost",
    ],
    (CLASSIFICATION, "Multi-class"): [
        "Decision Tree", "Random Forest", "Gradient Boosting (XGBoost)", "Support Vector Machine (SVM)",
        "K-Nearest Neighbors (KNN)", "Neural Networks",
    ],
    (REGRESSION, None): [
        "Linear Regression", "Ridge Regression", "Lasso Regression", "Decision Tree", "Random Forest",
        "Support Vector Regression (SVR)",
    ],
}


def _per_value(df: DataFrame, target: str) -> DataFrame:
    """Rows per non-null value; everything about the target's distinct values follows from it."""
    c = col(target)
    value = F.to_json(F.struct(c.alias("v"))) if kinds(df)[target] == NESTED else c
    return df.where(c.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def balance(max_percent: Column) -> Column:
    return F.when(max_percent > 70, "Imbalanced").otherwise("Balanced")


def severity(max_percent: Column) -> Column:
    return F.when(max_percent > 85, "Severe").when(max_percent > 70, "Moderate").otherwise("None")


def is_classification(data_type, unique: Column, non_null: Column) -> Column:
    """Numbers are classes when they have few distinct values; every other type is."""
    if kind_of(data_type) != NUMERIC:
        return F.lit(True)
    return (unique <= MAX_CLASS_VALUES) | (F.try_divide(unique.cast("double"), non_null) < MIN_DISTINCT_SHARE)


def analyze_target(df: DataFrame, target: str) -> DataFrame:
    """One row: type, counts, problem type, class balance or shape of the distribution.

    A target that is not in the table is an error; a target without values gives the ``error`` column.
    """
    if target not in df.columns:
        raise ValueError(f"there is no column {target!r} to analyse")
    data_type = df.schema[target].dataType
    classes = _per_value(df, target).agg(
        F.count(F.lit(1)).alias("unique_values"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_values"),
        F.max("n").alias("largest"),
    )
    x = finite_or_null(target) if kind_of(data_type) == NUMERIC else F.lit(None).cast("double")
    whole = df.agg(F.count(F.lit(1)).alias("n_rows"), adjusted_skewness(x).alias("skewness")).first()
    classed = F.col("problem_type") == CLASSIFICATION
    top = percent(F.col("largest"), F.col("total_values"))
    valid = F.col("total_values") > 0
    return (
        classes.withColumn("n_rows", F.lit(whole["n_rows"]).cast("long"))
        .withColumn("skewness", F.lit(whole["skewness"]).cast("double"))
        .withColumn(
            "problem_type",
            F.when(
                valid,
                F.when(is_classification(data_type, F.col("unique_values"), F.col("total_values")), CLASSIFICATION)
                .otherwise(REGRESSION),
            ),
        )
        .select(
            F.lit(target).alias("column_name"),
            F.lit(data_type.simpleString()).alias("data_type"),
            "unique_values",
            "total_values",
            (F.col("n_rows") - F.col("total_values")).alias("missing_values"),
            F.round(
                F.try_divide(F.lit(100.0) * (F.col("n_rows") - F.col("total_values")), F.col("n_rows")), 6
            ).alias("missing_percentage"),
            "problem_type",
            F.when(classed, F.when(F.col("unique_values") == 2, "Binary").otherwise("Multi-class")).alias("classification_type"),
            F.when(classed, balance(top)).alias("class_balance"),
            F.when(classed, severity(top)).alias("imbalance_severity"),
            F.when(~classed, skew_class(F.col("skewness"))).alias("distribution"),
            F.when(classed & F.lit(kind_of(data_type) == NUMERIC), "numeric_classes").alias("note"),
            F.when(~valid, "every value of the target is missing").alias("error"),
        )
    )


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(class, n, percentage of the non-null rows)."""
    total = df.agg(F.count(col(target))).first()[0]
    return _per_value(df, target).select(
        F.col("value").cast("string").alias("class"), "n", percent(F.col("n"), F.lit(total)).alias("percentage")
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Largest class share with its judgement."""
    top = _per_value(df, target).agg(F.max("n").alias("largest"), F.sum("n").alias("total"))
    share = percent(F.col("largest"), F.col("total"))
    return top.select(
        share.alias("max_percentage"), balance(share).alias("class_balance"), severity(share).alias("imbalance_severity")
    )


def target_statistics(df: DataFrame, target: str, digits: int = 4, exact: bool = True) -> DataFrame:
    """Mean, median, std, min, max, range and the bias-adjusted skewness and kurtosis."""
    median = quantiles(df, [target], [0.5], exact=exact)[target][0]
    x = finite_or_null(target)

    def rounded(c: Column, name: str) -> Column:
        return F.round(c, digits).alias(name)

    return df.agg(
        rounded(F.avg(x), "mean"),
        rounded(F.lit(median).cast("double"), "median"),
        rounded(F.stddev_samp(x), "std"),
        rounded(F.min(x), "min"),
        rounded(F.max(x), "max"),
        rounded(F.max(x) - F.min(x), "range"),
        rounded(adjusted_skewness(x), "skewness"),
        rounded(adjusted_kurtosis(x), "kurtosis"),
    )


def skewness_class(df: DataFrame, target: str, digits: int = 6) -> DataFrame:
    x = finite_or_null(target)
    return df.agg(adjusted_skewness(x).alias("g")).select(
        F.round("g", digits).alias("skewness"), skew_class(F.col("g")).alias("distribution")
    )


def _fences(df: DataFrame, column: str, exact: bool) -> tuple[list[float | None], float | None, float | None]:
    quartiles = quantiles(df, [column], [0.25, 0.5, 0.75], exact=exact)[column]
    if quartiles[0] is None:
        return quartiles, None, None
    reach = 1.5 * (quartiles[2] - quartiles[0])
    return quartiles, quartiles[0] - reach, quartiles[2] + reach


def target_outliers(df: DataFrame, target: str, exact: bool = True) -> DataFrame:
    """Values outside the fences: count, share of the non-null rows, and whether that is above 5 %."""
    _, low, high = _fences(df, target, exact)
    x = finite_or_null(target)
    out = F.count_if((x < F.lit(low).cast("double")) | (x > F.lit(high).cast("double")))
    counted = df.agg(out.alias("outliers"), F.count(x).alias("n"))
    share = F.try_divide(F.lit(100.0) * F.col("outliers"), F.col("n"))
    return counted.select("outliers", F.round(share, 6).alias("outlier_percentage"), (share > 5).alias("many_outliers"))


def box_stats(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """Quartiles, fences and the whisker ends: the outermost values inside the fences."""
    quartiles, low, high = _fences(df, column, exact)
    x = finite_or_null(column)
    low, high = F.lit(low).cast("double"), F.lit(high).cast("double")
    inside = F.when((x >= low) & (x <= high), x)
    return df.agg(
        *[F.lit(q).cast("double").alias(n) for q, n in zip(quartiles, ("q1", "median", "q3"))],
        low.alias("lower_fence"),
        high.alias("upper_fence"),
        F.min(inside).alias("whisker_low"),
        F.max(inside).alias("whisker_high"),
        F.count_if((x < low) | (x > high)).alias("outliers"),
    )


def target_recommendations(df: DataFrame, target: str) -> DataFrame:
    """Advice codes from the target analysis."""

    def note(code: str, detail: Column | str = "") -> dict[str, Column | str]:
        return {"code": code, "detail": detail}

    classed = F.col("problem_type") == CLASSIFICATION
    binary = F.col("classification_type") == "Binary"
    return findings(
        analyze_target(df, target).where("error IS NULL"),
        [
            (classed & binary, note("binary_classification")),
            (classed & ~binary, note("multiclass_classification", F.col("unique_values").cast("string"))),
            (classed & (F.col("class_balance") == "Imbalanced"), note("class_imbalance", F.col("imbalance_severity"))),
            (~classed, note("regression")),
            (~classed & (F.col("distribution") != "Approximately Normal"), note("non_normal", F.col("distribution"))),
            (F.col("missing_percentage") > 10, note("target_missing")),
            (F.col("total_values") < 1000, note("small_dataset")),
        ],
    )


def suitable_models(df: DataFrame, target: str) -> DataFrame:
    """The static list of models for the detected problem, in order."""
    analysis = analyze_target(df, target)
    lists = F.lit(None).cast("array<string>")
    for (problem, kind), names in SUITABLE_MODELS.items():
        match = F.col("problem_type") == problem
        if kind:
            match = match & (F.col("classification_type") == kind)
        lists = F.when(match, F.array(*[F.lit(n) for n in names])).otherwise(lists)
    return analysis.select(F.posexplode(lists).alias("position", "model")).withColumn("position", F.col("position") + 1)
