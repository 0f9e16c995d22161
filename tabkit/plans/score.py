"""Applying a trained model to new rows, in batch or on a stream."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.functions.kinds import NUMERIC, TEXT, col, columns_of
from tabkit.functions.quantiles import quantiles
from tabkit.functions.rules import percent
from tabkit.functions.stats import finite_or_null
from tabkit.operators.hygiene import fill_values
from tabkit.operators.target import CLASSIFICATION
from tabkit.plans.features import TablePrepModel, align_to_features, drop_intermediate
from tabkit.plans.train import Trained


def _prep(trained: Trained) -> TablePrepModel:
    return trained.pipeline.stages[0]


def score(trained: Trained, df: DataFrame) -> DataFrame:
    """The input columns, the prediction and, where the model gives them, class probabilities.

    Missing feature columns are an error, other columns are kept. The plan is a projection of the input for
    all models but nearest neighbours, so the same call serves batch and streaming tables.
    """
    prep = _prep(trained)
    ready = align_to_features(df, prep.get("numericCols"), prep.get("textCols"), prep.get("plainCols"))
    out = trained.pipeline.transform(ready)
    extra = []
    if trained.problem_type == CLASSIFICATION:
        extra.append(F.col("predicted_class").alias("prediction"))
        if "probability" in out.columns:
            chances = vector_to_array(F.col("probability"))
            extra += [chances[i].alias(f"prob_class_{c}") for i, c in enumerate(trained.classes)]
    else:
        extra.append(F.col("prediction"))
    return drop_intermediate(out).select(*[col(c) for c in df.columns], *extra)


def prediction_summary(scored: DataFrame, problem_type: str, prediction: str = "prediction", digits: int = 2) -> DataFrame:
    """Classes: count and share. Regression: mean, population std, min, max, median."""
    if problem_type == CLASSIFICATION:
        n = scored.count()
        counted = scored.groupBy(col(prediction).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
        return counted.withColumn("percentage", percent(F.col("n"), F.lit(n)))
    x = finite_or_null(prediction)
    median = F.lit(quantiles(scored, [prediction], [0.5])[prediction][0]).cast("double")
    facts = {"mean": F.avg(x), "std": F.stddev_pop(x), "min": F.min(x), "max": F.max(x), "median": median}
    items = [F.struct(F.lit(k).alias("statistic"), F.round(v, digits).alias("value")) for k, v in facts.items()]
    return scored.agg(F.array(*items).alias("a")).select(F.inline("a"))


def default_row(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row of usual values: the mean of numbers, the most frequent text."""
    numeric, text = columns_of(df, NUMERIC, exclude=[target]), columns_of(df, TEXT, exclude=[target])
    values = {**fill_values(df, "mean", numeric), **fill_values(df, "mode", text)}
    return df.sparkSession.range(1).select(*[values[c].alias(c) for c in df.columns if c in values])


def align_input(df: DataFrame, features: T.StructType) -> DataFrame:
    """The columns of the training table in their order: texts as text, all others as numbers or null."""
    text = {f.name for f in features.fields if isinstance(f.dataType, T.StringType)}
    missing = [f.name for f in features.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing in the data to score: {', '.join(missing)}")
    return df.select(
        *[
            (col(c).cast("string") if c in text else col(c).try_cast("double")).alias(c)
            for c in (f.name for f in features.fields)
        ]
    )
