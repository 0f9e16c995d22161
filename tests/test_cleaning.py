import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabkit.functions import ranking
from tabkit.operators import encode as E
from tabkit.operators import hygiene as H
from tabkit.operators import shortlist as R


def reasons(df, **options):
    return {(r["column_name"], r["reason"]) for r in H.detect_unwanted(df, **options).collect()}


def test_sequences_without_sorting(spark):
    df = spark.createDataFrame([(i, i / 2, 0.5 + i) for i in range(4)], "a int, b double, c double")
    found = reasons(df)
    assert ("a", "sequential") in found and ("c", "sequential") in found
    assert ("b", "increasing_sequence") in found and ("b", "sequential") not in found


def test_one_row_is_constant_and_sequential(spark):
    found = reasons(spark.createDataFrame([(5,)], "a int"))
    assert {("a", "constant"), ("a", "sequential")} <= found


def test_all_null_column_is_not_a_date(spark):
    df = spark.createDataFrame([(None, None)] * 3, "x double, y string")
    assert reasons(df) == {("x", "mostly_missing"), ("y", "mostly_missing")}


def test_target_is_not_judged(spark):
    df = spark.createDataFrame([(1, 1)], "user_id int, t int")
    assert {c for c, _ in reasons(df, target="user_id")} == {"t"}


def test_name_patterns():
    hits = ["o_orderkey", "l_linenumber", "user_id", "doc_id", "Customer", "ZIP_CODE"]
    assert all(H.name_matches(n) for n in hits)
    assert not any(H.name_matches(n) for n in ("c_custkey", "l_partkey", "price"))


def test_mode_of_nothing(spark):
    df = spark.createDataFrame([(None, None)] * 3, "x double, y string")
    assert [tuple(r) for r in H.impute_mode(df).distinct().collect()] == [(0.0, "Unknown")]


def test_text_is_untouched_by_mean_and_median(spark):
    df = spark.createDataFrame([(1, None), (None, "a"), (4, "b")], "x int, y string")
    assert [tuple(r) for r in H.impute_mean(df).collect()] == [(1.0, None), (2.5, "a"), (4.0, "b")]
    assert [r["x"] for r in H.impute_median(df).collect()] == [1.0, 2.5, 4.0]


def test_mode_keeps_types(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (DATE'2020-01-01', TIMESTAMP'2020-01-01 10:00:00', true, 2.50BD),"
        " (DATE'2020-01-01', TIMESTAMP'2020-01-01 10:00:00', true, 2.50BD), (null, null, null, null) AS t(d, ts, b, m)"
    )
    filled = H.impute_mode(df)
    assert filled.dtypes == df.dtypes
    assert filled.distinct().count() == 1


def test_removal_is_sequential(spark):
    # The second column's outlier disappears with the first column's, which tightens the second fence.
    data = [(float(i), float(i % 5)) for i in range(20)] + [(1000.0, 50.0), (5.0, 9.0)]
    df = spark.createDataFrame(data, "a double, b double")
    one = H.remove_outliers(df, ["a"])
    assert one.count() == 21
    expected = H.remove_outliers(one, ["b"]).count()
    assert H.remove_outliers(df, ["a", "b"]).count() == expected
    cleaned, handled = H.handle_outliers(df, "remove", ["a", "b"])
    assert handled == 22 - expected and cleaned.count() == expected


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=4, max_size=40))
def test_capping_is_idempotent_on_fixed_fences(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "a double")
    bounds = H.iqr_bounds(df, ["a"])["a"]
    capped = H.cap_outliers(df, ["a"])
    assert capped.where(F.col("a").isNull()).count() == sum(v is None for v in values)
    if bounds:
        assert capped.where((F.col("a") < bounds[0]) | (F.col("a") > bounds[1])).count() == 0


def test_zscore_of_a_constant(spark):
    assert H.zscore_outliers(spark.createDataFrame([(1.0,)] * 3, "a double"), "a").count() == 0


def test_frames_equal_counts_copies(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, t string")
    assert H.frames_equal(a, a.orderBy("k"))
    assert not H.frames_equal(a, a.distinct())
    assert not H.frames_equal(a, a.withColumn("k", F.col("k").cast("long")))


def test_factorize_by_first_appearance(spark):
    df = spark.createDataFrame([(1, "y"), (2, "x"), (3, None), (4, "y")], "k int, t string")
    assert [r["t"] for r in E.factorize(df, "t", "k").orderBy("k").collect()] == [0, 1, -1, 0]


def test_one_hot_null_is_all_false(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, t string")
    found = E.one_hot(df).orderBy("k").collect()
    assert found[0].asDict() == {"k": 1, "t_x": True, "t_y": False}
    assert found[2].asDict() == {"k": 3, "t_x": False, "t_y": False}
    with pytest.raises(ValueError, match="more than 1 values"):
        E.one_hot(df, max_categories=1)


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0), (1.0, 4.0)], "a double, b double")
    assert {r["a"] for r in E.standard_scale(df).collect()} == {0.0}
    assert [r["b"] for r in E.minmax_scale(df).collect()] == [None, 0.0, 1.0]


def test_scaled_columns_have_mean_zero_and_deviation_one(table):
    found = E.standard_scale(table("events").select("value")).agg(F.avg("value"), F.stddev_pop("value")).first()
    assert found[0] == pytest.approx(0, abs=1e-12) and found[1] == pytest.approx(1)


@pytest.mark.parametrize("limits", [(10**6, 10**6), (5, 10)])
def test_large_dictionaries_give_the_same_codes(spark, monkeypatch, limits):
    """One value holds a third of the rows; the dictionary is beyond the broadcast limit."""
    monkeypatch.setattr(E, "HOT_VALUES", 2)
    df = spark.range(600).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 1, None).otherwise(F.col("id").cast("string")).alias("t"))
    dictionary = ranking.with_position(
        df.groupBy(F.coalesce("t", F.lit("nan")).alias("value")).count().withColumnRenamed("count", "n"), ["value"], "code", one_task_rows=limits[0]
    )
    joined = E.join_dictionary(df, F.coalesce("t", F.lit("nan")), dictionary, "code", broadcast_rows=limits[1])
    got = joined.toPandas()
    order = {v: i for i, v in enumerate(sorted(got["t"].fillna("nan").unique()))}
    assert len(got) == 600 and got["code"].tolist() == [order[v] for v in got["t"].fillna("nan")]


def test_copies_of_a_hot_row_are_spread(spark):
    """Without the partition in the salt, all copies of a one-column row would meet in one task."""
    df = spark.range(0, 4000, 1, 8).select(F.lit("hot").alias("t"))
    dictionary = spark.createDataFrame([("hot", 0, 4000), ("rare", 1, 1)], "value string, code int, n long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = E.join_dictionary(df.hint("merge"), F.col("t"), dictionary, "code", broadcast_rows=1)
        tasks = joined.groupBy(F.spark_partition_id().alias("task"), "code").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {r["code"] for r in tasks} == {0} and sum(r["count"] for r in tasks) == 4000
    assert len({r["task"] for r in tasks}) > 1


def test_ranking_worked_example(spark):
    """Binary target, 15,000 rows, few features, one categorical."""
    facts = spark.createDataFrame(
        [("t", "y", "Classification", 15000, 6, 5, 1, False, 2, True)],
        "table_name string, target string, problem_type string, n_samples long, n_features int, n_numeric_features int,"
        " n_categorical_features int, has_missing_values boolean, n_classes long, is_binary boolean",
    )
    found = [(r["model"], r["score"]) for r in R.rank_models(facts).orderBy("rank").collect()]
    assert found == [
        ("Random Forest", 100), ("XGBoost", 100), ("Decision Tree", 85), ("Logistic Regression", 75),
        ("Support Vector Machine (SVM)", 75), ("K-Nearest Neighbors (KNN)", 50),
    ]


def test_rows_of_hot_values_are_not_shuffled(spark, monkeypatch):
    """The branch of coded rows has no exchange; only rows of other values are dealt out."""
    monkeypatch.setattr(E, "HOT_VALUES", 1)
    df = spark.range(0, 900, 1, 4).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id"))).alias("t"))
    dictionary = df.groupBy(F.col("t").alias("value")).agg(F.count("*").alias("n")).withColumn("code", F.xxhash64("value"))
    joined = E.join_dictionary(df, F.col("t"), dictionary, "code", broadcast_rows=1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    union = plan.index("Union")
    first = plan[union:].split("\n:- ")[1].split("\n+- ")[0]
    assert "BroadcastHashJoin" in first and "hashpartitioning" not in first and "hashpartitioning" in plan
    got = joined.collect()
    assert len(got) == 900 and {r["t"]: r["code"] for r in got} == {r["value"]: r["code"] for r in dictionary.collect()}


def test_long_one_hot_numbers_every_value(spark):
    rows = [(1, "b", "x"), (2, None, "y"), (3, "a", "x"), (4, "b", None), (4, "c" * 200, "x")]
    df = spark.createDataFrame(rows, "id long, s string, t string")
    for limit in (10**6, 1):
        got = sorted(tuple(r) for r in E.one_hot_long(df, "id", broadcast_rows=limit).collect())
        assert got == [(1, "s", 1), (1, "t", 3), (2, "t", 4), (3, "s", 0), (3, "t", 3), (4, "s", 1), (4, "s", 2), (4, "t", 3)]
    assert E.one_hot_long(df.limit(0), "id").count() == 0 and E.one_hot_long(df, "id", []).count() == 0
    wide = spark.range(3000).select("id", F.concat(F.lit("v"), F.col("id")).alias("s"))
    assert E.one_hot_long(wide, "id").select("position").distinct().count() == 3000


@pytest.mark.parametrize("method", ["remove", "cap"])
def test_handled_outliers_are_counted(table, method):
    df = table("events").select("event_id", "value")
    cleaned, handled = H.handle_outliers(df, method, ["value"])
    low, high = H.iqr_bounds(df, ["value"])["value"]
    outside = df.filter((F.col("value") < low) | (F.col("value") > high)).count()
    assert handled == outside > 0 and cleaned.count() == df.count() - (outside if method == "remove" else 0)
