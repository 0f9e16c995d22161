"""Repeated keys, infinities, nested and binary columns, and the one category limit."""

import pytest
from pyspark.sql import functions as F

from tabkit.operators import profile as P
from tabkit.operators.target import CLASSIFICATION
from tabkit.plans import train as T


def test_duplicates_compare_binary_and_nested_columns(spark):
    rows = [
        (1, b"a", [1, 2], {"x": 1, "y": 2}), (1, b"a", [1, 2], {"y": 2, "x": 1}),
        (1, b"b", [1, 2], {"x": 1, "y": 2}), (1, b"a", [2, 1], {"x": 1, "y": 2}), (1, b"a", [1, 2], None), (1, b"a", [1, 2], None),
    ]
    df = spark.createDataFrame(rows, "i int, b binary, a array<int>, m map<string, int>")
    assert P.duplicate_count(df).first()[0] == 2
    assert P.duplicate_count(df.withColumn("n", F.array("m"))).first()[0] >= 1
    assert P.duplicate_count(df.select(F.struct("i", "b").alias("a.b"), "a")).first()[0] == 3


def test_histogram_leaves_infinities_out(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "x double")
    found = [(r["bin_low"], r["bin_high"], r["n"]) for r in P.histogram(df, "x", bins=2).orderBy("bin").collect()]
    assert found == [(0.0, 0.5, 1), (0.5, 1.0, 1)]


def test_pair_sample_is_exact_on_repeated_keys(spark):
    df = spark.range(500).select((F.col("id") % 5).alias("k"), F.col("id").alias("x"))
    first, again = (sorted(tuple(r) for r in P.pair_sample(df.repartition(p), ["k"], n=120).collect()) for p in (2, 5))
    assert len(first) == 120 and first == again


def test_category_limit_reaches_the_target_and_the_search(spark):
    df = spark.range(60).select("id", (F.col("id") % 20).cast("string").alias("y"), F.rand(1).alias("x"))
    with pytest.raises(ValueError, match="more than 5 categories in y"):
        T.train(df, "y", "id", ["Logistic Regression"], CLASSIFICATION, folds=None, max_categories=5)
    with pytest.raises(ValueError, match="more than 5 categories in y"):
        T.search(df, "y", "id", "Logistic Regression", CLASSIFICATION, folds=3, max_categories=5)


def test_training_takes_folds_by_model_and_timestamps(spark):
    rows = spark.range(300).select("id", (F.rand(1) * 10).alias("x"), F.timestamp_seconds(F.col("id") * 86400).alias("day"))
    df = rows.withColumn("y", F.col("x") * 2 + F.unix_timestamp("day") / 86400)
    options = dict(problem_type="Regression", folds=4, folds_by_model={"Linear Regression": 2})
    plain = T.train(df, "y", "id", ["Linear Regression"], **options)
    timed = T.train(df, "y", "id", ["Linear Regression"], passthrough_timestamps=True, **options)
    run = timed.runs.first()
    assert len(run["cv_scores"]) == 2
    assert run["metrics"]["r2_score"] > 0.99 > plain.runs.first()["metrics"]["r2_score"]
