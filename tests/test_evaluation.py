import numpy as np
import pytest
from pyspark.sql import functions as F

from tabkit.functions.ranking import running_totals
from tabkit.operators import compare as K
from tabkit.operators import evaluate as V
from tabkit.operators import split as M


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "label int, score double")
    assert V.auc(df).first()["auc"] == pytest.approx(0.875)
    curve = V.roc_curve(df).orderBy(F.desc_nulls_first("threshold")).collect()
    assert [(r["fpr"], r["tpr"]) for r in curve] == [(0, 0), (0, 0.5), (0.5, 1), (1, 1)]


def test_auc_is_the_mann_whitney_statistic(spark):
    rng = np.random.default_rng(3)
    score, label = rng.integers(0, 50, 400) / 50, rng.integers(0, 2, 400)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(label, score)], "label int, score double")
    p, n = score[label == 1], score[label == 0]
    expected = ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))
    assert V.auc(df).first()["auc"] == pytest.approx(expected)


def test_class_that_is_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "label string, prediction string")
    found = {r["class"]: r for r in V.classification_report(df).collect()}
    assert (found["b"]["precision"], found["b"]["recall"], found["a"]["precision"]) == (0.0, 0.0, 0.5)
    assert found["accuracy"]["support"] == 0.5
    matrix = {(r["label"], r["prediction"]): r["n"] for r in V.confusion_matrix(df).collect()}
    assert matrix == {("a", "a"): 1, ("a", "b"): 0, ("b", "a"): 1, ("b", "b"): 0}


def test_matrix_has_one_shape_at_any_number_of_classes(spark):
    df = spark.range(300).select((F.col("id") % 30).alias("label"), (F.col("id") % 29).alias("prediction"))
    found = V.confusion_matrix(df)
    assert found.agg(F.sum("n")).first()[0] == 300 and found.count() == 900
    sparse = V.confusion_matrix(df, dense=False)
    assert sparse.agg(F.sum("n")).first()[0] == 300 and sparse.where("n = 0").count() == 0
    with pytest.raises(ValueError, match="classes"):
        V.confusion_matrix(df, max_classes=20)


def test_matrix_counts_null_as_a_class(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, "a")], "label string, prediction string")
    found = {(r["label"], r["prediction"]): r["n"] for r in V.confusion_matrix(df).collect()}
    assert found == {("a", "a"): 0, ("a", None): 2, (None, "a"): 1, (None, None): 0}


def test_r2_leaves_out_rows_without_a_prediction(spark):
    rows = [(1.0, 1.5), (2.0, 2.5), (1000.0, None)]
    found = V.regression_metrics(spark.createDataFrame(rows, "label double, prediction double")).first()
    assert found["r2_score"] == 0.0


def test_running_totals_place_a_null_key_alike_on_both_paths(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 2), (0.1, 3), (None, 4)], "k double, n long")
    for limit in (1_000_000, 1):
        found = {r["k"]: r["s"] for r in running_totals(df, "k", {"n": "s"}, one_task_rows=limit).collect()}
        assert found == {0.9: 1, 0.5: 3, 0.1: 6, None: 10}


def test_r2_without_variance(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "label double, prediction double")
    found = V.regression_metrics(df).first()
    assert found["r2_score"] is None and found["mae"] == 0.5


@pytest.fixture(scope="module")
def skewed(spark):
    """A class with a third of the rows, a rare class and rows without a class."""
    g = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "rare").when(F.col("id") % 50 == 2, None).otherwise(
        F.concat(F.lit("c"), (F.col("id") % 4).cast("string"))
    )
    return spark.range(5000).select("id", g.alias("g")).cache()


def test_split_is_disjoint_complete_exact_and_stable(skewed):
    train, test = M.split(skewed, "id", 0.2, stratify="g")
    assert train.count() + test.count() == 5000 and train.join(test, "id").count() == 0
    sizes = {r["g"]: r["count"] for r in skewed.groupBy("g").count().collect()}
    held = {r["g"]: r["count"] for r in test.groupBy("g").count().collect()}
    assert held == {g: int(n * 0.2 + 0.5) for g, n in sizes.items()}
    again = M.split(skewed.repartition(13), "id", 0.2, stratify="g")[1]
    assert sorted(r["id"] for r in again.collect()) == sorted(r["id"] for r in test.collect())
    assert sorted(r["id"] for r in M.split(skewed, "id", 0.2, seed=1, stratify="g")[1].collect()) != sorted(
        r["id"] for r in test.collect()
    )


@pytest.mark.parametrize("k", [2, 5, 7])
def test_folds_of_a_class_differ_by_at_most_one(skewed, k):
    counts = M.assign_folds(skewed, "id", k, stratify="g").groupBy("g").pivot("fold", list(range(k))).count().collect()
    for r in counts:
        sizes = [r[str(f)] or 0 for f in range(k)]
        assert max(sizes) - min(sizes) <= 1


def test_hash_split_is_close_to_its_share(skewed):
    share = M.assign_split(skewed, "id", 0.3, method="hash").agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert share == pytest.approx(0.3, abs=0.03)


def test_bad_split_arguments(skewed):
    with pytest.raises(ValueError):
        M.split(skewed, "id", 1.5)
    with pytest.raises(ValueError, match="not in the table"):
        M.split(skewed, "no_key")


@pytest.fixture(scope="module")
def runs(spark):
    data = [
        ("e", "r1", "A", "Classification", 2.0, 0.8, 0.02, {"accuracy": 0.9, "precision": 0.9, "recall": 0.9, "f1_score": 0.9}),
        ("e", "r2", "B", "Classification", 1.0, 0.7, 0.01, {"accuracy": 0.9, "precision": 0.8, "recall": 0.9, "f1_score": 0.85}),
        ("e", "r3", "C", "Classification", 12.0, 0.7, 0.10, {"accuracy": 0.6, "precision": 0.8, "recall": 0.9, "f1_score": 0.7}),
    ]
    return spark.createDataFrame(
        data,
        "experiment string, run_id string, model string, problem_type string, training_time_s double, cv_mean double,"
        " cv_std double, metrics map<string, double>",
    )


@pytest.mark.parametrize("limit", [None, 1])
def test_leaderboard_breaks_ties_by_name_on_both_paths(runs, limit):
    found = K.leaderboard(runs, "Classification", one_task_rows=limit).orderBy("rank").collect()
    assert [(r["rank"], r["model"]) for r in found] == [(1, "A"), (2, "B"), (3, "C")]


def test_winners(runs):
    found = {r["use_case"]: r["model"] for r in K.use_case_winners(runs, "Classification").collect()}
    assert found == {"best_performance": "A", "fastest": "B", "most_stable": "B"}
    assert K.best_model(runs, "Classification").first()["model"] == "A"


def test_run_insights(runs):
    found = {(r["model"], r["code"]) for r in K.run_insights(runs).collect()}
    assert {("C", "slow_training"), ("C", "unstable"), ("A", "consistent"), ("A", "good_accuracy"), ("C", "low_accuracy")} <= found


def test_equal_scores_have_z_zero(runs):
    same = runs.withColumn("metrics", F.create_map(F.lit("accuracy"), F.lit(0.5)))
    assert {r["z_score"] for r in K.score_zscores(same, "Classification").collect()} == {0.0}


def test_ranks_in_a_large_group(spark):
    from tabkit.functions.ranking import rank_within

    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("g"), (F.col("id") % 400).cast("double").alias("s"), "id")
    a = rank_within(df, ["g"], "s", ["id"], "r").orderBy("id").collect()
    b = rank_within(df, ["g"], "s", ["id"], "r", one_task_rows=100).select(*df.columns, "r").orderBy("id").collect()
    assert a == b
