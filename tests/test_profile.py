import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabkit.functions.kinds import normalise_nulls
from tabkit.operators import profile as P
from tabkit.operators import target as T


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "a double, b string")


def test_empty_table_is_the_only_invalid_one(empty):
    assert [(r["severity"], r["code"]) for r in rows(P.validate(empty))] == [("error", "empty")]


def test_profile_of_an_empty_table_lists_its_columns(empty):
    found = rows(P.column_profile(empty).orderBy("position"))
    assert [(r["column_name"], r["non_null"], r["unique_values"], r["missing_values"]) for r in found] == [
        ("a", 0, 0, 0), ("b", 0, 0, 0),
    ]


def test_one_row(spark):
    df = spark.createDataFrame([(7.0,)], "a double")
    described = rows(P.numeric_describe(df))[0]
    assert described["std"] is None and described["q50"] == 7.0


def test_nan_counts_as_missing_and_pairs_stay_complete(spark):
    df = normalise_nulls(
        spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 7.0), (4.0, 1.0), (math.nan, 3.0)], "a double, b double")
    )
    assert {r["column_name"]: r["missing_count"] for r in rows(P.missing_summary(df))} == {"a": 1, "b": 1}
    pair = P.correlation_matrix(df).where("col_a = 'a' AND col_b = 'b'").first()
    assert pair["corr"] == pytest.approx(np.corrcoef([1, 3, 4], [2, 7, 1])[0, 1])


@pytest.mark.parametrize("limit", [1000, 0])
def test_correlations_match_numpy_on_both_paths(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "NATIVE_CORRELATION_PAIRS", limit)
    rng = np.random.default_rng(1)
    x = rng.normal(1e6, 1, (500, 4))
    x[:, 1] += x[:, 0]
    x[:, 3] = 0.1
    holes = rng.random((500, 4)) < 0.2
    data = [[None if h else float(v) for v, h in zip(r, hr)] for r, hr in zip(x, holes)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in rows(P.correlation_matrix(df))}
    pdf = df.toPandas().astype(float)
    for i in "abc":
        for j in "abc":
            assert got[i, j] == pytest.approx(pdf[i].corr(pdf[j]), abs=1e-9)
        assert got[i, "d"] is None
    assert len(got) == 16


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(3)], "a double, b double")
    assert P.correlation_matrix(df).where("col_a <> col_b").first()["corr"] is None


def test_mode_is_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "t string")
    found = rows(P.categorical_stats(df))[0]
    assert (found["most_frequent"], found["frequency"], found["unique_values"], found["n_values"]) == ("a", 2, 2, 4)


def test_duplicates_treat_null_as_equal_but_not_its_place(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, 1), (None, 1), (2, 2)], "a int, b int")
    assert P.duplicate_count(df).first()[0] == 2
    assert P.duplicate_count(df.where("a = 2")).first()[0] == 0


def test_histogram_keeps_every_value_and_ignores_nulls(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "a double")
    found = rows(P.histogram(df, "a", bins=5).orderBy("bin"))
    assert [r["n"] for r in found] == [2, 2, 2, 2, 3]
    constant = rows(P.histogram(spark.createDataFrame([(4.0,)] * 3, "a double"), "a", bins=2))
    assert sum(r["n"] for r in constant) == 3 and constant[0]["bin_low"] == 3.5
    assert P.histogram(spark.createDataFrame([(None,)], "a double"), "a").count() == 0


def test_nested_columns_are_only_counted(spark):
    df = spark.createDataFrame([([1],), (None,)], "v array<int>")
    found = rows(P.column_profile(df))[0]
    assert (found["non_null"], found["unique_values"], found["missing_values"]) == (1, None, 1)


def test_approximate_profile_counts_exactly_and_estimates_distinct_values(table):
    exact = P.column_profile(table("customer")).orderBy("position").collect()
    close = P.column_profile(table("customer"), exact=False).orderBy("position").collect()
    for a, b in zip(exact, close):
        assert (a["column_name"], a["non_null"], a["missing_values"]) == (b["column_name"], b["non_null"], b["missing_values"])
        assert b["unique_values"] == pytest.approx(a["unique_values"], rel=0.15)


def test_pair_sample_is_stable_under_repartitioning(table):
    lines = table("lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    a, b = (P.pair_sample(t, key, n=100).toPandas() for t in (lines, lines.repartition(7)))
    assert len(a) == 100
    assert sorted(map(tuple, a.to_numpy())) == sorted(map(tuple, b.to_numpy()))


@pytest.mark.parametrize("shares, expected", [((86, 14), "Severe"), ((80, 20), "Moderate"), ((70, 30), "None")])
def test_imbalance_thresholds(spark, shares, expected):
    df = spark.createDataFrame([("a",)] * shares[0] + [("b",)] * shares[1], "t string")
    assert T.class_balance(df, "t").first()["imbalance_severity"] == expected
    assert T.analyze_target(df, "t").first()["imbalance_severity"] == expected


@pytest.mark.parametrize("distinct, expected", [(20, "Classification"), (21, "Regression")])
def test_numeric_target_with_few_values_is_a_class(spark, distinct, expected):
    df = spark.createDataFrame([(float(i % distinct),) for i in range(100)], "t double")
    assert T.analyze_target(df, "t").first()["problem_type"] == expected


def test_boolean_and_date_targets_are_classes(spark):
    df = spark.createDataFrame([(True,), (False,)], "t boolean").withColumn("d", F.current_date())
    assert T.analyze_target(df, "t").first()["classification_type"] == "Binary"
    assert T.analyze_target(df, "d").first()["problem_type"] == "Classification"


def test_target_errors(spark):
    df = spark.createDataFrame([(None,)], "t double")
    assert T.analyze_target(df, "t").first()["error"] == "every value of the target is missing"
    with pytest.raises(ValueError, match="no column"):
        T.analyze_target(df, "other")


def test_adjusted_moments_match_pandas(spark):

    values = [1.0, 2.0, 2.5, 9.0, 30.0]
    found = T.target_statistics(spark.createDataFrame([(v,) for v in values], "t double"), "t", digits=10).first()
    assert found["skewness"] == pytest.approx(pd.Series(values).skew())
    assert found["kurtosis"] == pytest.approx(pd.Series(values).kurtosis())


def test_mode_of_long_texts_is_the_text_itself(spark):
    a, b = "a" * 200, "b" * 200
    twice = spark.createDataFrame([(b,), (b,), (a,), (a,), ("c",), ("c",), ("d",)], "t string")
    found = rows(P.categorical_stats(twice))[0]
    assert (found["most_frequent"], found["frequency"], found["unique_values"]) == (a, 2, 4)
    once = spark.createDataFrame([(b,), (a,), ("zz",)], "t string")
    assert rows(P.categorical_stats(once))[0]["most_frequent"] == a


def test_many_columns_correlate_as_numpy_says(spark, monkeypatch):
    """Two hundred columns with gaps: one row of packed sums per task."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 200)) + rng.normal(size=(400, 1))
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 7] = 2.0
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(200)])).repartition(6)
    got = P.correlation_matrix(df).toPandas().pivot(index="col_a", columns="col_b", values="corr")
    expected = pd.DataFrame(x, columns=[f"c{i}" for i in range(200)]).corr()
    order = expected.columns
    a, b = got.loc[order, order].to_numpy(dtype=float), expected.to_numpy()
    assert np.isnan(a[7]).all() and np.allclose(np.delete(np.delete(a, 7, 0), 7, 1), np.delete(np.delete(b, 7, 0), 7, 1), atol=1e-9)
    p = 5
    total = np.stack([m + m.T if k in (0, 3) else m for k, m in enumerate(rng.normal(size=(4, p, p)))])
    assert np.allclose(P._unpacked_gram(P._packed_gram(total), p), total)


def test_correlations_of_no_rows(spark):
    empty = spark.createDataFrame([], ", ".join(f"c{i} double" for i in range(9)))
    assert P.correlation_matrix(empty).filter("corr IS NOT NULL").count() == 0
