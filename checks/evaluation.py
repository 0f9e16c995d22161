"""Checks of splitting, evaluation, comparison and reports."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from checks.profile import _INSIGHTS_SQL, _missing_sql, _overview_sql, histogram_sql, rounded_edges
from checks.sql import ORDERS, ORDERS_NULLS_COLUMNS, union
from checks.tables import (
    METRICS, ORDERS_NULLS, SCORED_BINARY_SQL, SCORED_CLASSES_SQL, SCORED_REGRESSION_SQL, load, orders_nulls, runs,
    runs_sql, scored_binary, scored_classes, scored_regression,
)
from tabkit.operators import compare as K
from tabkit.operators import evaluate as V
from tabkit.operators import split as M
from tabkit.sources import report as R

CLS, REG = "Classification", "Regression"
BINARY, CLASSES, REGRESSION = f"({SCORED_BINARY_SQL})", f"({SCORED_CLASSES_SQL})", f"({SCORED_REGRESSION_SQL})"
_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_ORDER_HASH = "md5('42|' || o_orderkey)"


def _rounded(df, digits=6):
    return df.select(
        *[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields]
    )


def _per_class(relation: str) -> str:
    return f"""
c AS (SELECT label::VARCHAR AS l, prediction::VARCHAR AS p, count(*) AS n FROM {relation} GROUP BY 1, 2),
k AS (SELECT l AS class FROM c UNION SELECT p FROM c),
s AS (SELECT class, coalesce((SELECT sum(n) FROM c WHERE l = class), 0)::DOUBLE AS support,
      coalesce((SELECT sum(n) FROM c WHERE p = class), 0)::DOUBLE AS predicted,
      coalesce((SELECT sum(n) FROM c WHERE l = class AND p = class), 0)::DOUBLE AS hits FROM k),
m AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
      coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f1 FROM s),
w AS (SELECT sum(hits) / sum(support) AS acc, sum(precision * support) / sum(support) AS p, sum(recall * support) / sum(support) AS r,
      sum(f1 * support) / sum(support) AS f, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf, sum(support) AS n FROM m)"""


def _metrics_sql(relation: str) -> str:
    return (
        f"WITH {_per_class(relation)} SELECT round(acc, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, "
        "round(f, 6) AS f1_score FROM w"
    )


def _report_sql(relation: str) -> str:
    return f"""WITH {_per_class(relation)}
SELECT class, round(precision, 3) AS precision, round(recall, 3) AS recall, round(f1, 3) AS f1, support FROM m
UNION ALL SELECT 'accuracy', round(acc, 3), round(acc, 3), round(acc, 3), round(acc, 3) FROM w
UNION ALL SELECT 'macro avg', round(mp, 3), round(mr, 3), round(mf, 3), n FROM w
UNION ALL SELECT 'weighted avg', round(p, 3), round(r, 3), round(f, 3), n FROM w"""


def _matrix_sql(relation: str) -> str:
    return f"""WITH t AS (SELECT * FROM {relation}), k AS (SELECT label AS c FROM t UNION SELECT prediction FROM t)
SELECT a.c AS label, b.c AS prediction, (SELECT count(*) FROM t WHERE label = a.c AND prediction = b.c) AS n FROM k a, k b"""


_ROC = f"""
t AS (SELECT score AS threshold, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM {BINARY} GROUP BY score),
c AS (SELECT threshold, pos, neg, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp FROM t),
n AS (SELECT sum(pos) AS p, sum(neg) AS n FROM t)"""

_QQ = ", ".join(f"({i / 100}, {NormalDist().inv_cdf(i / 100)!r})" for i in range(1, 100))

_BOX = f"""WITH t AS (SELECT label - prediction AS r FROM {REGRESSION}),
q AS (SELECT quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.75) AS q3 FROM t),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
  round(any_value(lo), 4) AS lower_fence, round(any_value(hi), 4) AS upper_fence,
  round(min(r) FILTER (r >= lo AND r <= hi), 4) AS whisker_low, round(max(r) FILTER (r >= lo AND r <= hi), 4) AS whisker_high,
  count(*) FILTER (r < lo OR r > hi) AS outliers FROM t, f"""

_LONG = {p: ", ".join(f"('{m}', {m}::DOUBLE)" for m in METRICS[p]) for p in METRICS}


def _summary_sql(problem):
    return f"SELECT experiment, model, training_time_s, cv_mean, cv_std, {', '.join(METRICS[problem])} FROM ({runs_sql(problem)})"


def _long_sql(problem, names):
    return union(f"SELECT experiment, model, '{m}' AS metric, {m}::DOUBLE AS value FROM ({runs_sql(problem)})" for m in names)


def _board_sql(problem):
    return f"""SELECT experiment, row_number() OVER (PARTITION BY experiment ORDER BY {METRICS[problem][0]} DESC, model)::INT AS rank, model,
               training_time_s, cv_mean, cv_std, {", ".join(METRICS[problem])} FROM ({runs_sql(problem)})"""


def _winners_sql(problem):
    score = METRICS[problem][0]
    return union(
        f"""SELECT experiment, '{case}' AS use_case, model, value FROM (SELECT experiment, model, {value} AS value,
            row_number() OVER (PARTITION BY experiment ORDER BY {order}, model) AS r FROM ({runs_sql(problem)})) WHERE r = 1"""
        for case, value, order in (
            ("best_performance", score, f"{score} DESC"), ("fastest", "training_time_s", "training_time_s"),
            ("most_stable", "cv_std", "cv_std"),
        )
    )


def _column_winners_sql(problem):
    names = [*METRICS[problem], "cv_mean", "cv_std", "training_time_s"]
    return f"""SELECT experiment, model, metric, value, value = CASE WHEN metric IN ('mae', 'mse', 'rmse', 'cv_std', 'training_time_s')
       THEN min(value) OVER w ELSE max(value) OVER w END AS is_best FROM ({_long_sql(problem, names)})
       WINDOW w AS (PARTITION BY experiment, metric)"""


_RADAR_REG = f"""SELECT experiment, model, r2_score, {", ".join(f"round(1 - {m} / max({m}) OVER (PARTITION BY experiment), 6) AS {m}" for m in ("mae", "mse", "rmse"))},
cv_mean AS cv_score FROM ({runs_sql(REG)})"""


def _report_value(sql_value):
    return f"CAST({sql_value} AS VARCHAR)"


_EDA_REPORT = f"""
WITH o AS ({_overview_sql(ORDERS_NULLS, ORDERS_NULLS_COLUMNS)})
SELECT 'overview' AS section, 'n_rows' AS item, n_rows::VARCHAR AS value FROM o
UNION ALL SELECT 'overview', 'n_columns', n_columns::VARCHAR FROM o
UNION ALL SELECT 'overview', 'columns_with_missing', columns_with_missing::VARCHAR FROM o
UNION ALL SELECT 'missing_values', column_name, missing_count::VARCHAR FROM ({_missing_sql(ORDERS_NULLS, ORDERS_NULLS_COLUMNS)})
UNION ALL SELECT 'insights', code, value::VARCHAR FROM ({_INSIGHTS_SQL})"""


def _eval_report_sql(problem):
    names = [*METRICS[problem], "training_time_s", "cv_mean", "cv_std"]
    return f"SELECT 'metrics' AS section, experiment || '/' || model || '/' || metric AS item, round(value, 4)::VARCHAR AS value FROM ({_long_sql(problem, names)})"


def _folds_sql(k, label):
    return f"SELECT o_orderkey, (ntile({k}) OVER (PARTITION BY {label} ORDER BY {_ORDER_HASH}) - 1)::INT AS fold FROM orders"


_MARKED = f"""SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_ORDER_HASH})
  <= round(count(*) OVER (PARTITION BY o_orderpriority) * 0.2) AS is_test FROM {ORDERS_NULLS}"""

_INSIGHT_SQL = union(
    f"SELECT experiment, model, '{code}' AS code FROM ({runs_sql(CLS)}) WHERE {cond}"
    for code, cond in (
        ("slow_training", "training_time_s > 10"), ("unstable", "cv_std > 0.05"), ("consistent", "cv_std <= 0.05"),
        ("excellent_accuracy", "accuracy > 0.9"), ("good_accuracy", "accuracy > 0.8 AND accuracy <= 0.9"),
        ("low_accuracy", "accuracy <= 0.8"),
    )
)

CHECKS = {
    "preparation_report": (
        lambda s, d: M.preparation_report(orders_nulls(s, d), "o_totalprice"),
        f"""SELECT count(*) AS n_samples, 7 AS n_features, round(100.0 * ({" + ".join(f"(count(*) - count({c}))" for c in ORDERS_NULLS_COLUMNS)})::DOUBLE / (count(*) * 7), 6) AS missing_percentage,
            'Numerical' AS target_type, round(min(o_totalprice), 6) AS target_min, round(max(o_totalprice), 6) AS target_max,
            round(skewness(o_totalprice), 6) AS target_skewness, abs(skewness(o_totalprice)) > 1 AS target_skewed,
            4 AS n_numeric_features, 3 AS n_categorical_features, NULL::BIGINT AS target_classes
            FROM {ORDERS_NULLS} WHERE o_totalprice IS NOT NULL""",
    ),
    "stratified_split": (
        lambda s, d: M.assign_split(orders_nulls(s, d), "o_orderkey", stratify="o_orderpriority").select("o_orderkey", "is_test"),
        _MARKED,
    ),
    "train_rows": (
        lambda s, d: M.split(orders_nulls(s, d), "o_orderkey", stratify="o_orderpriority")[0].select("o_orderkey"),
        f"SELECT o_orderkey FROM ({_MARKED}) WHERE NOT is_test",
    ),
    "random_split": (
        lambda s, d: M.assign_split(load(s, d, "lineitem"), _LINE_KEY, 0.3, seed=7).select(*_LINE_KEY, "is_test"),
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           row_number() OVER (ORDER BY md5('7|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey))
           <= round(count(*) OVER () * 0.3) AS is_test FROM lineitem""",
    ),
    "hash_split": (
        lambda s, d: M.assign_split(load(s, d, "orders"), "o_orderkey", method="hash").select("o_orderkey", "is_test"),
        f"SELECT o_orderkey, ('0x' || substr({_ORDER_HASH}, 1, 15))::BIGINT < {int(0.2 * (1 << 60))} AS is_test FROM orders",
    ),
    "cv_folds": (
        lambda s, d: M.assign_folds(load(s, d, "orders"), "o_orderkey", 5, stratify="o_orderstatus").select("o_orderkey", "fold"),
        _folds_sql(5, "o_orderstatus"),
    ),
    "cv_folds_plain": (
        lambda s, d: M.assign_folds(load(s, d, "orders"), "o_orderkey", 3).select("o_orderkey", "fold"),
        _folds_sql(3, "1"),
    ),
    "classification_metrics": (lambda s, d: _rounded(V.classification_metrics(scored_classes(s, d))), _metrics_sql(CLASSES)),
    "classification_metrics_binary": (lambda s, d: _rounded(V.classification_metrics(scored_binary(s, d))), _metrics_sql(BINARY)),
    "classification_report": (lambda s, d: V.classification_report(scored_classes(s, d)), _report_sql(CLASSES)),
    "confusion_matrix": (lambda s, d: V.confusion_matrix(scored_classes(s, d)), _matrix_sql(CLASSES)),
    "regression_metrics": (
        lambda s, d: V.regression_metrics(scored_regression(s, d)).select(
            F.round("r2_score", 6).alias("r2_score"), F.round("mae", 2).alias("mae"), F.round("mse", 0).alias("mse"), F.round("rmse", 2).alias("rmse")
        ),
        f"""SELECT round(1 - avg((label - prediction) ** 2) / var_pop(label), 6) AS r2_score, round(avg(abs(label - prediction)), 2) AS mae,
            round(avg((label - prediction) ** 2), 0) AS mse, round(sqrt(avg((label - prediction) ** 2)), 2) AS rmse FROM {REGRESSION}""",
    ),
    "roc_curve": (
        lambda s, d: _rounded(V.roc_curve(scored_binary(s, d))),
        f"""WITH {_ROC} SELECT NULL::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
            UNION ALL SELECT round(threshold, 6), round(fp / n, 6), round(tp / p, 6) FROM c, n""",
    ),
    "auc": (
        lambda s, d: _rounded(V.auc(scored_binary(s, d))),
        f"WITH {_ROC} SELECT round(sum(neg * (tp - pos / 2)) / any_value(p * n), 6) AS auc FROM c, n",
    ),
    "residuals": (
        lambda s, d: V.residuals(scored_regression(s, d)),
        f"SELECT *, label - prediction AS residual FROM {REGRESSION}",
    ),
    "residual_histogram": (
        lambda s, d: rounded_edges(V.residual_histogram(scored_regression(s, d))),
        histogram_sql(f"(SELECT label - prediction AS residual FROM {REGRESSION})", ["residual"]),
    ),
    "qq_table": (
        lambda s, d: _rounded(V.qq_table(scored_regression(s, d))),
        f"""WITH p(prob, z) AS (VALUES {_QQ}),
            q AS (SELECT unnest(quantile_cont(label - prediction, [{", ".join(str(i / 100) for i in range(1, 100))}])) AS v, generate_subscripts([{", ".join(str(i / 100) for i in range(1, 100))}], 1) AS i FROM {REGRESSION})
            SELECT prob::DOUBLE AS prob, round(z::DOUBLE, 6) AS normal_quantile, round(v, 6) AS residual_quantile
            FROM (SELECT *, row_number() OVER (ORDER BY prob) AS i FROM p) JOIN q USING (i)""",
    ),
    "error_box": (lambda s, d: _rounded(V.error_box(scored_regression(s, d)), 4), _BOX),
    "actual_vs_predicted": (
        lambda s, d: V.actual_vs_predicted(scored_regression(s, d)),
        f"""SELECT label AS actual, prediction::DOUBLE AS predicted, least(min(label) OVER (), min(prediction) OVER ())::DOUBLE AS line_low,
            greatest(max(label) OVER (), max(prediction) OVER ())::DOUBLE AS line_high FROM {REGRESSION}""",
    ),
    "training_summary": (lambda s, d: K.training_summary(runs(s, d), CLS), _summary_sql(CLS)),
    "best_model": (
        lambda s, d: K.best_model(runs(s, d, REG), REG),
        f"""SELECT experiment, model, r2_score AS score, cv_mean FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY r2_score DESC, model) AS r
            FROM ({runs_sql(REG)})) WHERE r = 1""",
    ),
    "leaderboard": (lambda s, d: K.leaderboard(runs(s, d), CLS), _board_sql(CLS)),
    "leaderboard_regression": (lambda s, d: K.leaderboard(runs(s, d, REG), REG), _board_sql(REG)),
    "column_winners": (lambda s, d: K.column_winners(runs(s, d, REG), REG), _column_winners_sql(REG)),
    "metrics_long": (lambda s, d: K.metrics_long(runs(s, d), CLS), _long_sql(CLS, METRICS[CLS])),
    "radar_scores": (lambda s, d: _rounded(K.radar_scores(runs(s, d, REG), REG)), _RADAR_REG),
    "radar_scores_classes": (
        lambda s, d: K.radar_scores(runs(s, d), CLS),
        f"SELECT experiment, model, {', '.join(METRICS[CLS])}, cv_mean AS cv_score FROM ({runs_sql(CLS)})",
    ),
    "use_case_winners": (lambda s, d: K.use_case_winners(runs(s, d), CLS), _winners_sql(CLS)),
    "tradeoffs": (
        lambda s, d: K.tradeoffs(runs(s, d), CLS),
        f"""SELECT experiment, model, 'score_vs_time' AS chart, training_time_s AS x, accuracy AS y FROM ({runs_sql(CLS)})
            UNION ALL SELECT experiment, model, 'score_vs_stability', cv_std, f1_score FROM ({runs_sql(CLS)})""",
    ),
    "score_zscores": (
        lambda s, d: K.score_zscores(runs(s, d), CLS),
        f"""SELECT experiment, model, round(accuracy, 4) AS score, round(avg(accuracy) OVER w, 4) AS mean,
            round(stddev_pop(accuracy) OVER w, 4) AS std, round(CASE WHEN stddev_pop(accuracy) OVER w > 0
            THEN (accuracy - avg(accuracy) OVER w) / stddev_pop(accuracy) OVER w ELSE 0 END, 4) AS z_score
            FROM ({runs_sql(CLS)}) WINDOW w AS (PARTITION BY experiment)""",
    ),
    "run_insights": (lambda s, d: K.run_insights(runs(s, d)), _INSIGHT_SQL),
    "eda_report": (lambda s, d: R.eda_report(orders_nulls(s, d), "o_orderstatus"), _EDA_REPORT),
    "evaluation_report": (lambda s, d: R.evaluation_report(runs(s, d), CLS), _eval_report_sql(CLS)),
    "comparison_report": (
        lambda s, d: R.comparison_report(runs(s, d, REG), REG),
        f"""SELECT 'leaderboard' AS section, experiment || '/' || rank AS item, model AS value FROM ({_board_sql(REG)})
            UNION ALL SELECT 'recommendations', experiment || '/' || use_case, model FROM ({_winners_sql(REG)})""",
    ),
}
