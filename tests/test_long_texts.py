"""Answers that must not depend on the length of a text or the size of a number."""

from pyspark.sql import functions as F

from tabkit.operators import encode, hygiene, profile
from tabkit.sources import registry


def _reasons(df, column):
    return {r["reason"] for r in hygiene.detect_unwanted(df).where(F.col("column_name") == column).collect()}


def test_long_date_texts_are_date_strings(spark):
    long = spark.range(20).select(F.concat(F.lit("2024-01-0"), F.col("id") % 9 + 1, F.lit(" " + "x" * 100)).alias("d"))
    assert "date_string" in _reasons(long, "d")


def test_a_text_that_looks_like_a_digest_is_a_value_of_its_own(spark):
    long = "y" * 100
    rows = spark.createDataFrame([(long,)], "t string")
    looks = rows.select(F.concat(F.lit("md5:"), F.md5("t"), F.lit(":100")).alias("t"))
    digest = rows.select(F.concat(F.left("t", F.lit(10)), F.lit(":"), F.sha2("t", 256), F.lit(":100")).alias("t"))
    both = rows.union(looks).union(digest)
    assert profile.column_profile(both).first()["unique_values"] == 3
    coded = encode.label_encode(both, ["t"])
    assert coded.count() == 3 and coded.distinct().count() == 3


def test_large_ids_are_sequential(spark):
    base = 1_700_000_000_000_000_000
    df = spark.range(50).select((F.col("id") + base).alias("a"), (F.col("id") * 2 + base).alias("b"))
    assert "sequential" in _reasons(df, "a")
    assert "sequential" not in _reasons(df, "b") and "increasing_sequence" in _reasons(df, "b")


def test_factorize_orders_equal_places_by_value(spark):
    df = spark.createDataFrame([(1, "y"), (1, "x"), (1, "z")], "k long, v string")
    found = {r["v"] for r in encode.factorize(df, "v", "k").collect()}
    codes = {r["old"]: r["v"] for r in encode.factorize(df.withColumn("old", F.col("v")), "v", "k").collect()}
    assert found == {0, 1, 2} and codes == {"x": 0, "y": 1, "z": 2}


def test_an_empty_registry_lists_nothing(spark, tmp_path):
    assert registry.list_models(spark, str(tmp_path)).count() == 0
