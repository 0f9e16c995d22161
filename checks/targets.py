"""Checks of target analysis and the model shortlist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from checks.sql import LINEITEM, ORDERS, ORDERS_NULLS_COLUMNS, union
from checks.tables import LINEITEM_NULLS, ORDERS_NULLS, lineitem_nulls, load, orders_nulls
from tabkit.operators import shortlist as R
from tabkit.operators import target as T

_EVENTS = {"event_id": "bigint", "user_id": "bigint", "ts": "timestamp_ntz", "event_type": "string", "props": "string", "value": "double"}
_LABELS = {"doc_id": "bigint", "quality": "int", "toxic": "int"}
_PART = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}
_CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


def _analysis_sql(relation: str, column: str, data_type: str) -> str:
    numeric = data_type in ("bigint", "int", "double")
    skew = f"skewness({column}::DOUBLE)" if numeric else "NULL::DOUBLE"
    classed = "(u <= 20 OR u / t::DOUBLE < 0.05)" if numeric else "true"
    top = "round(100.0 * big::DOUBLE / t, 2)"
    return f"""
SELECT '{column}' AS column_name, '{data_type}' AS data_type, u AS unique_values, t AS total_values,
  n - t AS missing_values, round(100.0 * (n - t)::DOUBLE / n, 6) AS missing_percentage,
  CASE WHEN {classed} THEN 'Classification' ELSE 'Regression' END AS problem_type,
  CASE WHEN {classed} THEN CASE WHEN u = 2 THEN 'Binary' ELSE 'Multi-class' END END AS classification_type,
  CASE WHEN {classed} THEN CASE WHEN {top} > 70 THEN 'Imbalanced' ELSE 'Balanced' END END AS class_balance,
  CASE WHEN {classed} THEN CASE WHEN {top} > 85 THEN 'Severe' WHEN {top} > 70 THEN 'Moderate' ELSE 'None' END END AS imbalance_severity,
  CASE WHEN NOT {classed} THEN CASE WHEN abs(sk) > 1 THEN 'Highly Skewed' WHEN abs(sk) > 0.5 THEN 'Moderately Skewed'
       ELSE 'Approximately Normal' END END AS distribution,
  CASE WHEN {classed} AND {str(numeric).lower()} THEN 'numeric_classes' END AS note, NULL::VARCHAR AS error
FROM (SELECT count(*) AS n, count({column}) AS t, count(DISTINCT {column}) AS u, {skew} AS sk FROM {relation}),
     (SELECT max(c) AS big FROM (SELECT count(*) AS c FROM {relation} WHERE {column} IS NOT NULL GROUP BY {column}))"""


_ANALYSED = [
    (lambda s, d: orders_nulls(s, d), ORDERS_NULLS, "o_orderstatus", "string"),
    (lambda s, d: orders_nulls(s, d), ORDERS_NULLS, "o_totalprice", "double"),
    (lambda s, d: load(s, d, "events"), "events", "value", "double"),
    (lambda s, d: load(s, d, "labels"), "labels", "quality", "int"),
    (lambda s, d: load(s, d, "labels"), "labels", "toxic", "int"),
    (lambda s, d: load(s, d, "part"), "part", "p_size", "int"),
    (lambda s, d: load(s, d, "lineitem"), "lineitem", "l_discount", "double"),
    (lambda s, d: load(s, d, "supplier"), "supplier", "s_acctbal", "double"),
]


def _each(operator):
    def run(s, d):
        parts = [operator(load_(s, d), c).withColumn("target", F.lit(c)) for load_, _, c, _ in _ANALYSED]
        return reduce(lambda a, b: a.unionByName(b), parts)

    return run


def _analysis_all() -> str:
    return union(f"SELECT *, '{c}' AS target FROM ({_analysis_sql(r, c, t)})" for _, r, c, t in _ANALYSED)


_RECOMMENDATIONS = f"""
WITH a AS ({_analysis_all()})
SELECT target, 'binary_classification' AS code, '' AS detail FROM a WHERE classification_type = 'Binary'
UNION ALL SELECT target, 'multiclass_classification', unique_values::VARCHAR FROM a WHERE classification_type = 'Multi-class'
UNION ALL SELECT target, 'class_imbalance', imbalance_severity FROM a WHERE class_balance = 'Imbalanced'
UNION ALL SELECT target, 'regression', '' FROM a WHERE problem_type = 'Regression'
UNION ALL SELECT target, 'non_normal', distribution FROM a WHERE distribution <> 'Approximately Normal'
UNION ALL SELECT target, 'target_missing', '' FROM a WHERE missing_percentage > 10
UNION ALL SELECT target, 'small_dataset', '' FROM a WHERE total_values < 1000
"""


def _models_sql() -> str:
    rows = []
    for (problem, kind), names in T.SUITABLE_MODELS.items():
        for i, name in enumerate(names, 1):
            rows.append(f"('{problem}', {f'{chr(39)}{kind}{chr(39)}' if kind else 'NULL'}, {i}, '{name}')")
    return f"""
WITH a AS ({_analysis_all()}), m(problem, kind, position, model) AS (VALUES {", ".join(rows)})
SELECT target, position, model FROM a JOIN m ON a.problem_type = m.problem AND (m.kind IS NULL OR a.classification_type = m.kind)"""


_TABLES = [
    ("orders", orders_nulls, ORDERS_NULLS, ORDERS_NULLS_COLUMNS, "o_orderstatus", None),
    ("orders", orders_nulls, ORDERS_NULLS, ORDERS_NULLS_COLUMNS, "o_totalprice", None),
    ("lineitem", lineitem_nulls, LINEITEM_NULLS, LINEITEM, "l_extendedprice", None),
    ("lineitem", lineitem_nulls, LINEITEM_NULLS, LINEITEM, "l_linestatus", None),
    ("events", lambda s, d: load(s, d, "events"), "events", _EVENTS, "value", None),
    ("labels", lambda s, d: load(s, d, "labels"), "labels", _LABELS, "quality", "Classification"),
    ("labels", lambda s, d: load(s, d, "labels"), "labels", _LABELS, "toxic", None),
    ("part", lambda s, d: load(s, d, "part"), "part", _PART, "p_type", None),
    ("customer", lambda s, d: load(s, d, "customer"), "customer", _CUSTOMER, "c_acctbal", "Regression"),
]


def _facts(s, d):
    rows = [R.dataset_characteristics(frame(s, d), c, p, name) for name, frame, _, _, c, p in _TABLES]
    return reduce(lambda a, b: a.unionByName(b), rows)


def _facts_sql() -> str:
    def one(name, relation, columns, c, problem):
        kind = columns[c]
        numeric = kind in ("bigint", "int", "double")
        forced = problem == "Classification" or not numeric
        heuristic = f"(u <= 20 OR u / nn::DOUBLE < 0.05)" if numeric else "true"
        classes = "true" if forced else heuristic
        problem_sql = f"'{problem}'" if problem else f"CASE WHEN {classes} THEN 'Classification' ELSE 'Regression' END"
        feats = {k: v for k, v in columns.items() if k != c}
        nnum = sum(v in ("bigint", "int", "double") for v in feats.values())
        ntxt = sum(v == "string" for v in columns.values())
        miss = " + ".join(f"(count(*) - count({k}))" for k in columns)
        spread = f"(max({c}) - min({c}))::DOUBLE" if numeric else "NULL::DOUBLE"
        std = f"stddev_samp({c}::DOUBLE)" if numeric else "NULL::DOUBLE"
        hide = "true" if forced else "false"
        return f"""
SELECT '{name}' AS table_name, '{c}' AS target, {problem_sql} AS problem_type, n AS n_samples,
 {len(feats)} AS n_features, {nnum} AS n_numeric_features, {ntxt} AS n_categorical_features,
 miss > 0 AS has_missing_values, round(100.0 * miss::DOUBLE / (n * {len(columns)}), 6) AS missing_percentage,
 '{"numeric" if numeric else "categorical"}' AS target_type,
 CASE WHEN {classes} THEN u END AS n_classes, CASE WHEN {classes} THEN u = 2 END AS is_binary,
 CASE WHEN {classes} THEN round(bal, 6) END AS class_balance,
 CASE WHEN NOT {hide} THEN round(spread, 6) END AS target_range, CASE WHEN NOT {hide} THEN round(sd, 6) END AS target_std
FROM (SELECT count(*) AS n, count({c}) AS nn, count(DISTINCT {c}) AS u, ({miss})::BIGINT AS miss, {spread} AS spread, {std} AS sd FROM {relation}),
 (SELECT min(k) / max(k)::DOUBLE AS bal FROM (SELECT count(*) AS k FROM {relation} WHERE {c} IS NOT NULL GROUP BY {c}))"""

    return union(one(name, rel, cols, c, p) for name, _, rel, cols, c, p in _TABLES)


def _catalogue_sql() -> str:
    rows, position = [], {}
    for problem, name, suit, comp, feats, cats, miss in R.CATALOGUE:
        position[problem] = position.get(problem, 0) + 1
        rows.append(
            f"('{problem}', {position[problem]}, '{name}', '{suit}', '{comp}', {feats}, {cats}, {miss})".replace("True", "true").replace("False", "false")
        )
    return "m(problem, position, model, suit, complexity, feats, cats, miss) AS (VALUES " + ", ".join(rows) + ")"


def _suitability_sql() -> str:
    return f"""
WITH f AS ({_facts_sql()}), {_catalogue_sql()},
r AS (SELECT f.*, m.*, CASE
  WHEN model = 'Logistic Regression' THEN CASE WHEN is_binary THEN 'High' ELSE 'Medium' END
  WHEN model = 'Support Vector Machine (SVM)' THEN CASE WHEN n_samples < 100000 THEN 'High' ELSE 'Medium' END
  WHEN model = 'Linear Regression' THEN CASE WHEN n_features < n_samples THEN 'High' ELSE 'Medium' END
  ELSE suit END AS suitability
  FROM f JOIN m ON f.problem_type = m.problem)"""


def _rank_sql(bonus: bool) -> str:
    return f"""{_suitability_sql()},
s AS (SELECT *,
  25 * CASE suitability WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END
  + CASE WHEN n_samples < 1000 THEN CASE complexity WHEN 'Low' THEN 15 WHEN 'High' THEN -10 ELSE 0 END
         WHEN n_samples > 100000 THEN CASE WHEN model IN ('K-Nearest Neighbors (KNN)', 'Support Vector Machine (SVM)', 'Support Vector Regression (SVR)') THEN -15
              WHEN model IN ('Random Forest', 'XGBoost') THEN 10 ELSE 0 END ELSE 0 END
  + CASE WHEN n_features > 100 THEN CASE WHEN feats THEN 10 WHEN model = 'K-Nearest Neighbors (KNN)' THEN -15 ELSE 0 END ELSE 0 END
  + CASE WHEN {str(bonus).lower()} AND has_missing_values AND miss THEN 10 ELSE 0 END
  + CASE WHEN n_categorical_features > 0 AND cats THEN 10 ELSE 0 END AS score FROM r)
SELECT table_name, target, problem_type, row_number() OVER (PARTITION BY table_name, target ORDER BY score DESC, position)::INT AS rank,
  model, suitability, complexity, score::INT AS score FROM s"""


CHECKS = {
    "analyze_target": (_each(T.analyze_target), _analysis_all()),
    "class_distribution": (
        lambda s, d: T.class_distribution(orders_nulls(s, d), "o_orderpriority"),
        f"""SELECT o_orderpriority AS class, count(*) AS n,
            round(100.0 * count(*)::DOUBLE / (SELECT count(o_orderpriority) FROM {ORDERS_NULLS}), 2) AS percentage
            FROM {ORDERS_NULLS} WHERE o_orderpriority IS NOT NULL GROUP BY 1""",
    ),
    "class_distribution_numeric": (
        lambda s, d: T.class_distribution(load(s, d, "part"), "p_size"),
        """SELECT p_size::VARCHAR AS class, count(*) AS n,
           round(100.0 * count(*)::DOUBLE / (SELECT count(*) FROM part), 2) AS percentage FROM part GROUP BY 1""",
    ),
    "class_balance": (
        lambda s, d: T.class_balance(load(s, d, "labels"), "quality"),
        """SELECT p AS max_percentage, CASE WHEN p > 70 THEN 'Imbalanced' ELSE 'Balanced' END AS class_balance,
           CASE WHEN p > 85 THEN 'Severe' WHEN p > 70 THEN 'Moderate' ELSE 'None' END AS imbalance_severity
           FROM (SELECT round(100.0 * max(c)::DOUBLE / sum(c), 2) AS p FROM (SELECT count(*) AS c FROM labels GROUP BY quality))""",
    ),
    "target_statistics": (
        lambda s, d: T.target_statistics(load(s, d, "events"), "value"),
        """SELECT round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_samp(value), 4) AS std,
           round(min(value), 4) AS min, round(max(value), 4) AS max, round(max(value) - min(value), 4) AS range,
           round(skewness(value), 4) AS skewness, round(kurtosis(value), 4) AS kurtosis FROM events""",
    ),
    "skew_class": (
        lambda s, d: T.skewness_class(load(s, d, "events"), "value"),
        """SELECT round(g, 6) AS skewness, CASE WHEN abs(g) > 1 THEN 'Highly Skewed' WHEN abs(g) > 0.5 THEN 'Moderately Skewed'
           ELSE 'Approximately Normal' END AS distribution FROM (SELECT skewness(value) AS g FROM events)""",
    ),
    "target_outliers": (
        lambda s, d: T.target_outliers(load(s, d, "events"), "value"),
        """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events),
           c AS (SELECT count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS o, count(*) AS n FROM events, q)
           SELECT o AS outliers, round(100.0 * o::DOUBLE / n, 6) AS outlier_percentage, 100.0 * o::DOUBLE / n > 5 AS many_outliers FROM c""",
    ),
    "box_stats": (
        lambda s, d: T.box_stats(load(s, d, "events"), "value"),
        """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events),
           f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
           SELECT any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3, any_value(lower_fence) AS lower_fence,
           any_value(upper_fence) AS upper_fence,
           min(value) FILTER (value >= lower_fence AND value <= upper_fence) AS whisker_low,
           max(value) FILTER (value >= lower_fence AND value <= upper_fence) AS whisker_high,
           count(*) FILTER (value < lower_fence OR value > upper_fence) AS outliers FROM events, f""",
    ),
    "target_recommendations": (_each(T.target_recommendations), _RECOMMENDATIONS),
    "suitable_models": (_each(T.suitable_models), _models_sql()),
    "dataset_characteristics": (_facts, _facts_sql()),
    "recommend_models": (
        lambda s, d: R.recommend_models(_facts(s, d)).select("table_name", "target", "position", "model", "suitability", "complexity"),
        f"{_suitability_sql()} SELECT table_name, target, position, model, suitability, complexity FROM r",
    ),
    "rank_models": (lambda s, d: R.rank_models(_facts(s, d)), _rank_sql(False)),
    "rank_models_missing_bonus": (lambda s, d: R.rank_models(_facts(s, d), missing_bonus=True), _rank_sql(True)),
    "top_models": (
        lambda s, d: R.top_models(_facts(s, d)),
        f"SELECT *, rank = 1 AS is_default FROM ({_rank_sql(False)}) WHERE rank <= 3",
    ),
    "size_advice": (
        lambda s, d: R.size_advice(_facts(s, d)),
        f"""WITH f AS ({_facts_sql()})
        SELECT table_name, target, 'wide_target_range' AS code FROM f WHERE problem_type = 'Regression' AND target_range > 1000
        UNION ALL SELECT table_name, target, 'small_dataset' FROM f WHERE n_samples < 1000
        UNION ALL SELECT table_name, target, 'large_dataset' FROM f WHERE n_samples > 50000
        UNION ALL SELECT table_name, target, 'high_dimensional' FROM f WHERE n_features > 50""",
    ),
}
