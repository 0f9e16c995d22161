"""Checks of trained models on targets that follow from the features, with noise from the key.

DuckDB cannot train a forest, but it can say which rows must be predicted, that probabilities add up to one and that a
working model beats the largest class or explains most of the variance. What it can train, a tree of one split, it
trains: its split, leaves, scores and metrics must be equal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.evaluation import _matrix_sql, _report_sql, _rounded
from checks.tables import load
from tabkit.operators import evaluate as V
from tabkit.operators.target import CLASSIFICATION, REGRESSION
from tabkit.plans import models as D
from tabkit.plans import score as A
from tabkit.plans import train as T
from tabkit.plans.boosting import NewtonBoost
from tabkit.plans.epsilon import EpsilonRegression
from tabkit.plans.kernels import KernelMachine

_STRENGTH = "(o_totalprice + CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 90000 ELSE 0 END + (o_orderkey * 7919 % 1000) * 40)"
_TIER = f"CASE WHEN {_STRENGTH} < 170000 THEN 'low' WHEN {_STRENGTH} < 330000 THEN 'mid' ELSE 'high' END"
_LARGE = f"CASE WHEN {_STRENGTH} > 260000 THEN 'yes' ELSE 'no' END"
_WORTH = "(p_size * 30 + CASE WHEN p_type LIKE 'E%' THEN 700 WHEN p_type LIKE 'S%' THEN 300 ELSE 0 END + (p_partkey * 7919 % 100) * 2)"


def _orders(spark, d, target):
    return load(spark, d, "orders").withColumn("target", F.expr(target))


def _parts(spark, d):
    return load(spark, d, "part").withColumn("worth", F.expr(_WORTH).cast("double"))


def _test_orders(target: str) -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5('42|' || o_orderkey)) <= round(count(*) OVER (PARTITION BY target) * 0.2) AS is_test
FROM (SELECT *, {target} AS target FROM orders))"""


_TEST_PARTS = "(SELECT *, row_number() OVER (ORDER BY md5('42|' || p_partkey)) <= round(count(*) OVER () * 0.2) AS is_test FROM part)"


def _classifier(name, target=_TIER, probabilities=True):
    """One row per test row, with whether its probabilities add up to one and the model beats the largest class."""

    def run(spark, d):
        trained = T.train(_orders(spark, d, target), "target", "o_orderkey", [name], CLASSIFICATION, folds=None)
        scored = A.score(trained.models[name], trained.test.drop("label"))
        hit = F.avg((F.col("prediction") == F.col("target")).cast("double"))
        accuracy = scored.agg(hit).first()[0]
        largest = trained.test.groupBy("target").count().agg(F.max("count") / F.sum("count")).first()[0]
        chances = [c for c in scored.columns if c.startswith("prob_class_")]
        told = [(F.abs(sum((F.col(c) for c in chances), F.lit(0.0)) - 1) < 1e-6).alias("sums_to_one")] if probabilities else []
        return scored.select("o_orderkey", *told, F.lit(accuracy > largest + 0.1).alias("beats_majority"))

    told = "true AS sums_to_one, " if probabilities else ""
    return run, f"SELECT o_orderkey, {told}true AS beats_majority FROM {_test_orders(target)} WHERE is_test"


def _regressor(name, least=0.7, scale=1):
    """One row per test row, with whether the model explains most of the variance."""

    def run(spark, d):
        trained = T.train(_parts(spark, d).withColumn("worth", F.col("worth") / scale), "worth", "p_partkey", [name], REGRESSION, folds=None)
        scored = A.score(trained.models[name], trained.test.drop("label"))
        r2 = V.regression_metrics(scored, "worth", "prediction").first()["r2_score"]
        return scored.select("p_partkey", F.lit(r2 > least).alias("fits"), F.col("prediction").isNotNull().alias("predicted"))

    return run, f"SELECT p_partkey, true AS fits, true AS predicted FROM {_TEST_PARTS} WHERE is_test"


def _importance(spark, d):
    trained = T.train(_orders(spark, d, _TIER), "target", "o_orderkey", ["Random Forest"], CLASSIFICATION, folds=None)
    found = T.feature_importance(trained.models["Random Forest"], trained.test, 10_000)
    top = F.max(F.struct("importance", "feature"))["feature"]
    return found.agg(
        F.count("*").alias("n_features"), top.alias("top_feature"), (F.abs(F.sum("importance") - 1) < 1e-6).alias("sums_to_one"),
        (F.min("importance") >= 0).alias("none_negative"),
    )


_IMPORTANCE = f"""SELECT 2 + count(DISTINCT o_orderstatus) + count(DISTINCT o_orderpriority) AS n_features, 'num__o_totalprice' AS top_feature,
true AS sums_to_one, true AS none_negative FROM {_test_orders(_TIER)} WHERE NOT is_test"""


def _sizes(spark, d):
    names = ["Linear Regression", "Lasso Regression", "Decision Tree"]
    trained = T.train(_parts(spark, d), "worth", "p_partkey", names, REGRESSION, folds=None)
    rows = [(n, k, v) for n, m in trained.models.items() for k, v in D.model_size(m.model).items()]
    return spark.createDataFrame(rows, "model string, item string, size int")


_SIZES = f"""WITH w AS (SELECT (2 + count(DISTINCT p_name) + count(DISTINCT p_brand) + count(DISTINCT p_type))::INT AS size FROM {_TEST_PARTS} WHERE NOT is_test)
SELECT 'Linear Regression' AS model, 'coefficients' AS item, size FROM w UNION ALL SELECT 'Lasso Regression', 'coefficients', size FROM w
UNION ALL SELECT 'Decision Tree', 'features', size FROM w"""


def _runs(spark, d):
    """A whole training call: two models, test metrics and fold scores."""
    trained = T.train(_orders(spark, d, _TIER), "target", "o_orderkey", ["Logistic Regression", "Decision Tree"], CLASSIFICATION)
    largest = trained.test.groupBy("target").count().agg(F.max("count") / F.sum("count")).first()[0]
    metrics = [F.col("metrics")[m].between(0, 1) for m in ("accuracy", "precision", "recall", "f1_score")]
    inside = metrics[0] & metrics[1] & metrics[2] & metrics[3]
    mean = F.aggregate("cv_scores", F.lit(0.0), lambda a, x: a + x) / F.size("cv_scores")
    return trained.runs.select(
        "experiment", "run_id", "model", "problem_type", F.size("cv_scores").alias("n_folds"), inside.alias("metrics_are_shares"),
        (F.abs(mean - F.col("cv_mean")) < 1e-9).alias("mean_of_folds"), (F.col("metrics")["accuracy"] > largest + 0.1).alias("beats_majority"),
        (F.col("cv_mean") > largest + 0.1).alias("folds_beat_majority"),
    )


_RUNS = """SELECT 'default' AS experiment, 'default/' || model AS run_id, model, 'Classification' AS problem_type, 5 AS n_folds,
true AS metrics_are_shares, true AS mean_of_folds, true AS beats_majority, true AS folds_beat_majority
FROM (SELECT unnest(['Logistic Regression', 'Decision Tree']) AS model)"""


def _epsilon(spark, d):
    """The epsilon-insensitive objective at the fitted weights, summed over the rows, against the bound of its dual."""
    rows = _parts(spark, d).select("p_partkey", "p_size", "p_retailprice", (F.col("worth") / 100).alias("label"))
    moments = rows.agg(*[f(c) for c in ("p_size", "p_retailprice") for f in (F.avg, F.stddev_pop)]).first()
    scaled = [((F.col(c) - moments[2 * i]) / moments[2 * i + 1]).alias(f"x{i}") for i, c in enumerate(("p_size", "p_retailprice"))]
    vectors = VectorAssembler(inputCols=["x0", "x1"], outputCol="features").transform(rows.select("label", *scaled))
    model = EpsilonRegression(C=0.5, epsilon=0.1).fit(vectors)
    (a, b), offset = model.coefficients, model.intercept
    loss = F.greatest(F.abs(F.col("label") - F.lit(a) * F.col("x0") - F.lit(b) * F.col("x1") - F.lit(offset)) - 0.1, F.lit(0.0))
    value = F.lit((a * a + b * b) / 2) + 0.5 * F.sum(loss)
    bound = F.lit(model.getOrDefault(model.bound))
    return vectors.agg(F.count("*").alias("n_rows"), ((value - bound) <= 1e-3 * value).alias("near_its_bound"), (value >= bound).alias("not_below_it"))


_EPSILON = "SELECT count(*) AS n_rows, true AS near_its_bound, true AS not_below_it FROM part"


def _conditions(spark, d):
    """The exact kernel machine on customers: for every row whether its optimality condition holds, from the table of
    support vectors and multipliers."""
    rows = load(spark, d, "customer").selectExpr("c_custkey", "c_acctbal / 1000 AS a", "c_nationkey / 5 AS b", f"{_SIDE} AS label")
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    model = KernelMachine(C=2.0, gamma=0.3).fit(vectors)
    (x, weights, offset), = model._machines()
    points, weights = np.array(x), np.array(weights)
    multipliers = {(p[0], p[1]): abs(w) for p, w in zip(points.tolist(), weights.tolist(), strict=True)}

    @F.pandas_udf("value double, own double")
    def at(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        value, step = np.full(len(a), offset), max((1 << 18) // len(points), 1)
        for start in range(0, len(a), step):
            part = slice(start, start + step)
            far = np.subtract.outer(a.to_numpy()[part], points[:, 0]) ** 2
            far += np.subtract.outer(b.to_numpy()[part], points[:, 1]) ** 2
            far *= -0.3
            value[part] += np.exp(far, out=far) @ weights
        return pd.DataFrame({"value": value, "own": [multipliers.get(p, 0.0) for p in zip(a.tolist(), b.tolist(), strict=True)]})

    told = rows.repartition("c_custkey").withColumn("at", at("a", "b"))
    side, own = F.when(F.col("label") == 1, 1.0).otherwise(-1.0), F.col("at.own")
    margin, near = side * F.col("at.value"), 5e-3
    holds = F.when(own == 0, margin >= 1 - near).when(own >= 2.0, margin <= 1 + near).otherwise(F.abs(margin - 1) <= near)
    return told.select("c_custkey", holds.alias("condition_holds"))


_SIDE = "CASE WHEN (c_acctbal / 1000 - 4) * (c_acctbal / 1000 - 4) + (c_nationkey / 5 - 2) * (c_nationkey / 5 - 2) * 4 > 9 THEN 1.0 ELSE 0.0 END"
_CONDITIONS = "SELECT c_custkey, true AS condition_holds FROM customer"


def _split(spark, d):
    """Boosting with one round of one split: where it splits and what the leaves say."""
    rows = _parts(spark, d).select("p_size", F.col("worth").alias("label"))
    vectors = VectorAssembler(inputCols=["p_size"], outputCol="features").transform(rows)
    model = NewtonBoost(rounds=1, depth=1, rate=0.1).fit(vectors)
    scored = model.transform(vectors).select("p_size", F.round("prediction", 6).alias("prediction"))
    return scored.groupBy("prediction").agg(F.max("p_size").alias("to_size"), F.count("*").alias("n"))


def _best_split(table: str, g: str, h: str) -> str:
    """The best split of ``table`` (x, y, and the mean b of y) by gradients and hessians."""
    return f"""v AS (SELECT x, sum({g}) AS g, sum({h}) AS h FROM {table} GROUP BY x),
c AS (SELECT x, sum(g) OVER (ORDER BY x) AS gl, sum(h) OVER (ORDER BY x) AS hl, sum(g) OVER () AS ga, sum(h) OVER () AS ha FROM v),
s AS (SELECT x AS cut_at, -gl / (hl + 1) AS low, -(ga - gl) / (ha - hl + 1) AS high FROM c WHERE hl >= 1 AND ha - hl >= 1
      ORDER BY gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1) DESC, x LIMIT 1)"""


_SPLIT = f"""WITH t AS (SELECT p_size AS x, {_WORTH}::DOUBLE AS y, avg({_WORTH}::DOUBLE) OVER () AS b FROM part),
{_best_split("t", "b - y", "1.0")}
SELECT round(b + 0.1 * CASE WHEN x <= cut_at THEN low ELSE high END, 6) AS prediction, max(x) AS to_size, count(*) AS n FROM t, s GROUP BY 1"""


def _stump(spark, d):
    """The scored test rows of a classifier that is one split of one feature."""
    rows = load(spark, d, "part").select("p_partkey", "p_size", F.expr(_BULKY).alias("bulky"))
    one = {"XGBoost": {"n_estimators": 1, "max_depth": 1, "learning_rate": 1.0}}
    trained = T.train(rows, "bulky", "p_partkey", ["XGBoost"], CLASSIFICATION, folds=None, params=one)
    return trained.scored["XGBoost"].withColumn("score", vector_to_array("probability")[1])


_BULKY = "CASE WHEN p_size * 30 + (p_partkey * 7919 % 100) * 8 > 1100 THEN 'yes' ELSE 'no' END"
_STUMP = f"""t AS (SELECT p_size AS x, {_BULKY} AS bulky, p_partkey FROM part),
m AS (SELECT *, CASE bulky WHEN 'yes' THEN 1.0 ELSE 0.0 END AS y,
      row_number() OVER (PARTITION BY bulky ORDER BY md5('42|' || p_partkey)) <= round(count(*) OVER (PARTITION BY bulky) * 0.2) AS is_test FROM t),
r AS (SELECT *, avg(y) OVER () AS b FROM m WHERE NOT is_test), {_best_split("r", "b - y", "b * (1 - b)")},
z AS (SELECT bulky, y, 1 / (1 + exp(-(ln(b / (1 - b)) + CASE WHEN x <= cut_at THEN low ELSE high END))) AS score
      FROM (SELECT * FROM m WHERE is_test), s, (SELECT any_value(b) AS b FROM r))"""
_JUDGED = f"(WITH {_STUMP} SELECT bulky AS label, CASE WHEN score > 0.5 THEN 'yes' ELSE 'no' END AS prediction FROM z)"
_ROC = f"""WITH {_STUMP}, k AS (SELECT round(score, 9) AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM z GROUP BY 1),
e AS (SELECT threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM k WINDOW w AS (ORDER BY threshold DESC)), n AS (SELECT sum(pos) AS p, sum(neg) AS n FROM k)
SELECT round(threshold, 6) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM e, n UNION ALL SELECT NULL, 0, 0"""

CHECKS = {
    "train_models": (_runs, _RUNS),
    "logistic_regression": _classifier("Logistic Regression"),
    "decision_tree": _classifier("Decision Tree"),
    "random_forest": _classifier("Random Forest"),
    "support_vector_machine": _classifier("Support Vector Machine (SVM)", _LARGE, probabilities=False),
    "support_vector_multiclass": _classifier("Support Vector Machine (SVM)", probabilities=False),
    "knn_model": _classifier("K-Nearest Neighbors (KNN)"),
    "boosted_trees": _classifier("XGBoost", _LARGE),
    "boosted_multiclass": _classifier("XGBoost"),
    "boosted_split": (_split, _SPLIT),
    "decision_tree_regression": _regressor("Decision Tree"),
    "random_forest_regression": _regressor("Random Forest"),
    "support_vector_regression": _regressor("Support Vector Regression (SVR)", scale=1000),
    "epsilon_objective": (_epsilon, _EPSILON),
    "support_vector_conditions": (_conditions, _CONDITIONS),
    "boosted_trees_regression": _regressor("XGBoost"),
    "feature_importance": (_importance, _IMPORTANCE),
    "model_sizes": (_sizes, _SIZES),
    "trained_roc": (lambda s, d: _rounded(V.roc_curve(_stump(s, d).withColumn("score", F.round("score", 9)))), _ROC),
    "trained_report": (lambda s, d: V.classification_report(_stump(s, d), "bulky", "predicted_class"), _report_sql(_JUDGED)),
    "trained_matrix": (lambda s, d: V.confusion_matrix(_stump(s, d), "bulky", "predicted_class"), _matrix_sql(_JUDGED)),
}
