"""Evaluation of scored tables: ``label`` and ``prediction`` columns, for ROC also a score.

Everything on classes follows from the counts per (label, prediction): one shuffle of a table as small as
the number of class pairs.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.functions.kinds import as_double, col
from tabkit.functions.quantiles import quantiles
from tabkit.functions.ranking import running_totals
from tabkit.operators.profile import histogram
from tabkit.operators.target import box_stats

MATRIX_CLASSES = 1000


def pair_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n) of the pairs that occur."""
    return df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def per_class(pairs: DataFrame) -> DataFrame:
    """(class, support, predicted, hits) with precision, recall and F1; an empty denominator gives 0."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).cast("long")
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("label").cast("string").alias("class"), F.col("n").alias("s"), zero.alias("p"), hit.alias("h")),
        F.struct(F.col("prediction").cast("string").alias("class"), zero.alias("s"), F.col("n").alias("p"), zero.alias("h")),
    )
    counted = pairs.select(F.inline(sides)).groupBy("class").agg(
        F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits")
    )
    return counted.select(
        "class",
        "support",
        "predicted",
        "hits",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def _weighted(name: str) -> Column:
    return _ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and the support-weighted precision, recall and F1."""
    return per_class(pair_counts(df, label, prediction)).agg(
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        _weighted("precision").alias("precision"),
        _weighted("recall").alias("recall"),
        _weighted("f1").alias("f1_score"),
    )


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction", digits: int = 3
) -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy, macro average and weighted average."""
    classes = per_class(pair_counts(df, label, prediction))
    support = F.sum("support").cast("double")
    accuracy = _ratio(F.sum("hits"), F.sum("support"))

    def line(name: str, precision: Column, recall: Column, f1: Column, last: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
            last.alias("support"),
        )

    totals = classes.agg(
        F.array(
            line("accuracy", accuracy, accuracy, accuracy, accuracy),
            line("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1"), support),
            line("weighted avg", _weighted("precision"), _weighted("recall"), _weighted("f1"), support),
        ).alias("a")
    ).select(F.inline("a"))
    rows = classes.select("class", "precision", "recall", "f1", F.col("support").cast("double"))
    return rows.unionByName(totals).select(
        "class", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1", "support")]
    )


def confusion_matrix(
    df: DataFrame, label: str = "label", prediction: str = "prediction", dense: bool = True, max_classes: int = MATRIX_CLASSES
) -> DataFrame:
    """(label, prediction, n): all pairs of classes, also those with 0 rows, or with ``dense=False`` only the
    pairs that occur. A dense table of more than ``max_classes`` classes is refused. Null is a class."""
    pairs = pair_counts(df, label, prediction)
    if not dense:
        return pairs
    classes = pairs.select(F.explode(F.array("label", "prediction")).alias("c")).distinct()
    found = [r["c"] for r in classes.limit(max_classes + 1).collect()]
    if len(found) > max_classes:
        raise ValueError(f"more than {max_classes} classes: ask for dense=False or raise max_classes")
    field = pairs.schema["label"].dataType.simpleString()
    grid = df.sparkSession.createDataFrame([(c,) for c in found], f"label {field}").withColumn(
        "prediction", F.explode(F.array(*[F.lit(c).cast(field) for c in found]))
    )
    counted = pairs.select(F.col("label").alias("_l"), F.col("prediction").alias("_p"), "n")
    same = F.col("label").eqNullSafe(F.col("_l")) & F.col("prediction").eqNullSafe(F.col("_p"))
    return grid.join(F.broadcast(counted), same, "left").select("label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """R2, MAE, MSE and RMSE in one aggregate, over the rows that have both values; R2 is null when the label
    does not vary."""
    error = as_double(label) - as_double(prediction)
    y = F.when(error.isNotNull(), as_double(label))
    mse = F.avg(error * error)
    return df.agg(
        (1 - F.try_divide(mse, F.var_pop(y))).alias("r2_score"),
        F.avg(F.abs(error)).alias("mae"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
    )


def _score_counts(df: DataFrame, label: str, score: str, positive) -> DataFrame:
    hit = (col(label) == F.lit(positive)).cast("long")
    return df.groupBy(as_double(score).alias("threshold")).agg(
        F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg")
    )


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, from the highest down, and the start point (0, 0).

    Rows are reduced to one per distinct score before anything is ordered.
    """
    points = _score_counts(df, label, score, positive)
    totals = points.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    curve = running_totals(points, "threshold", {"pos": "tp", "neg": "fp"})
    start = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(
        curve.select(
            "threshold",
            F.try_divide(F.col("fp").cast("double"), F.lit(totals["n"])).alias("fpr"),
            F.try_divide(F.col("tp").cast("double"), F.lit(totals["p"])).alias("tpr"),
        )
    )


def auc(df: DataFrame, label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """Area under the ROC curve by the trapezoid rule."""
    points = _score_counts(df, label, score, positive)
    curve = running_totals(points, "threshold", {}, {"pos": "above"})
    area = F.sum(F.col("neg").cast("double") * (F.col("above") + F.col("pos") / 2))
    return curve.agg(F.try_divide(area, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def residuals(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The scored rows with ``residual = label - prediction``."""
    return df.withColumn("residual", as_double(label) - as_double(prediction))


def residual_histogram(
    df: DataFrame, label: str = "label", prediction: str = "prediction", bins: int = 30
) -> DataFrame:
    return histogram(residuals(df, label, prediction), "residual", bins)


def qq_table(
    df: DataFrame, label: str = "label", prediction: str = "prediction", points: int = 99, exact: bool = True
) -> DataFrame:
    """Residual quantiles against standard normal quantiles on a fixed grid of probabilities."""
    probs = [(i + 1) / (points + 1) for i in range(points)]
    found = quantiles(residuals(df, label, prediction), ["residual"], probs, exact=exact)["residual"]
    rows = [(p, NormalDist().inv_cdf(p), q) for p, q in zip(probs, found)]
    return df.sparkSession.createDataFrame(rows, "prob double, normal_quantile double, residual_quantile double")


def error_box(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return box_stats(residuals(df, label, prediction), "residual")


def actual_vs_predicted(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(actual, predicted) per row with the ends of the line of perfect prediction."""
    y, p = as_double(label), as_double(prediction)
    low, high = df.agg(F.least(F.min(y), F.min(p)), F.greatest(F.max(y), F.max(p))).first()
    return df.select(
        y.alias("actual"), p.alias("predicted"),
        F.lit(low).cast("double").alias("line_low"), F.lit(high).cast("double").alias("line_high"),
    )
