"""Checks of features, models, search, scoring, saved models, CSV and streams.

Models with one numeric feature have closed forms, so DuckDB can fit, cross-validate and search them too.
"""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks import learned
from checks.sql import ORDERS_NULLS_COLUMNS, union
from checks.tables import ORDERS_NULLS, load, orders_nulls
from tabkit.operators import knn as N
from tabkit.operators import split as M
from tabkit.operators.target import CLASSIFICATION, REGRESSION
from tabkit.plans import models as D
from tabkit.plans import score as A
from tabkit.plans import train as T
from tabkit.plans.features import FEATURES, feature_names, feature_stages
from tabkit.session import ensure_checkpoint_dir
from tabkit.sources import files, registry
from tabkit.streaming import scoring as S


def scratch(spark, name: str) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _sales(spark, d):
    """One numeric feature and a target that depends on it."""
    return load(spark, d, "lineitem").selectExpr(
        *_KEY, "l_extendedprice AS price", "l_extendedprice * (1 - l_discount) AS paid"
    )


_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_HASH = "md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey)"
_SALES = f"""s AS (SELECT {", ".join(_KEY)}, l_extendedprice AS x, l_extendedprice * (1 - l_discount) AS y, {_HASH} AS h FROM lineitem)"""
_SPLIT = f"{_SALES}, m AS (SELECT *, row_number() OVER (ORDER BY h) <= round(count(*) OVER () * 0.2) AS is_test FROM s)"
_LINE = "f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM m WHERE NOT is_test)"


def _fit_one(spark, d, name, **params):
    """(coefficient, intercept) of a model on the standardised price."""
    df = _sales(spark, d).withColumn("label", F.col("paid"))
    vectors = Pipeline(stages=feature_stages(df, "paid", [*_KEY, "label"])).fit(df).transform(df)
    model = D.get_estimator(name, REGRESSION, **params).fit(vectors)
    return spark.createDataFrame(
        [(round(float(model.coefficients[0]), 3), round(float(model.intercept), 3))], "coefficient double, intercept double"
    )


def _closed_form(coefficient: str) -> str:
    return f"""WITH {_SALES}, q AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n FROM s),
z AS (SELECT sum((x - mx) / sx * (y - my)) AS zy, any_value(n) AS n, any_value(my) AS my FROM s, q)
SELECT round({coefficient}, 3) AS coefficient, round(my, 3) AS intercept FROM z"""


def _train_sales(spark, d, folds=None, models=("Linear Regression",)):
    return T.train(_sales(spark, d), "paid", _KEY, list(models), problem_type=REGRESSION, folds=folds, experiment="sales")


def _run_row(runs):
    metrics = [F.round(F.col("metrics")[m], 4).alias(m) for m in ("r2_score", "mae", "rmse")]
    return runs.select("experiment", "model", "problem_type", *metrics)


_TEST_METRICS = f"""WITH {_SPLIT}, {_LINE}, p AS (SELECT y, a + b * x AS p FROM m, f WHERE is_test)
SELECT 'sales' AS experiment, 'Linear Regression' AS model, 'Regression' AS problem_type,
 round(1 - avg((y - p) ** 2) / var_pop(y), 4) AS r2_score, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) ** 2)), 4) AS rmse FROM p"""

_FOLD_R2 = f"""{_SPLIT}, t AS (SELECT *, ntile(5) OVER (ORDER BY h) - 1 AS fold FROM m WHERE NOT is_test),
k AS (SELECT range AS fold FROM range(5)),
c AS (SELECT k.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM k JOIN t ON t.fold <> k.fold GROUP BY k.fold),
r AS (SELECT fold, 1 - avg((y - a - b * x) ** 2) / var_pop(y) AS r2 FROM t JOIN c USING (fold) GROUP BY fold)"""

_ALPHAS = [0.1, 1.0, 10.0, 100.0]
_SEARCH_SQL = f"""WITH {_SALES}, t AS (SELECT *, ntile(3) OVER (ORDER BY h) - 1 AS fold FROM s),
k AS (SELECT fold, alpha FROM range(3) r(fold), (VALUES (0.1::DOUBLE), (1.0), (10.0), (100.0)) v(alpha)),
q AS (SELECT k.fold, alpha, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n, covar_pop(x, y) AS cxy
      FROM k JOIN t ON t.fold <> k.fold GROUP BY k.fold, alpha),
c AS (SELECT fold, alpha, mx, sx, my, n * cxy / sx / (n + alpha) AS w FROM q),
r AS (SELECT alpha, fold, 1 - avg((y - my - w * (x - mx) / sx) ** 2) / var_pop(y) AS r2 FROM t JOIN c USING (fold) GROUP BY alpha, fold)
SELECT alpha::VARCHAR AS alpha, round(avg(r2), 6) AS cv_mean, round(stddev_pop(r2), 6) AS cv_std FROM r GROUP BY alpha"""


def _search_sales(spark, d, method, **options):
    found = T.search(_sales(spark, d), "paid", _KEY, "Ridge Regression", REGRESSION, method, folds=3, **options)
    return found.select(
        F.col("params")["alpha"].alias("alpha"), F.round("cv_mean", 6).alias("cv_mean"), F.round("cv_std", 6).alias("cv_std")
    )


_PREDICTED = f"""WITH {_SPLIT}, {_LINE} SELECT {", ".join(_KEY)}, round(a + b * x, 3) AS prediction FROM m, f"""


def _predictions(scored):
    return scored.select(*_KEY, F.round("prediction", 3).alias("prediction"))


def _batch_score(spark, d):
    """Rows to score lack the target and carry the feature as text."""
    model = _train_sales(spark, d).models["Linear Regression"]
    rows = _sales(spark, d).drop("paid").withColumn("price", F.col("price").cast("string"))
    return _predictions(A.score(model, rows))


def _saved_score(spark, d):
    folder = scratch(spark, "registry")
    registry.save_model(spark, _train_sales(spark, d).models["Linear Regression"], folder)
    newest = registry.list_models(spark, folder).first()
    return _predictions(A.score(registry.load_model(spark, folder, newest["id"]), _sales(spark, d)))


def _saved_list(spark, d):
    folder = scratch(spark, "registry")
    trained = _train_sales(spark, d, models=("Linear Regression", "Ridge Regression"))
    for model in trained.models.values():
        registry.save_model(spark, model, folder)
    return registry.list_models(spark, folder).select("model_name", "problem_type", "target_column", "version")


def _stream_score(spark, d):
    model = _train_sales(spark, d).models["Linear Regression"]
    source, out = scratch(spark, "rows"), scratch(spark, "scored")
    files.write_parquet(_sales(spark, d).repartition(4), source)
    stream = S.read_stream(spark, source, _sales(spark, d).schema, max_files=2)
    query = S.write_scored(S.score_stream(model, stream), out, scratch(spark, "progress"), available_now=True)
    query.awaitTermination()
    return _predictions(files.read_parquet(spark, out))


def _csv_score(spark, d):
    model = _train_sales(spark, d).models["Linear Regression"]
    path = scratch(spark, "csv")
    files.write_csv(_sales(spark, d).drop("paid"), path)
    rows = files.read_scoring_csv(spark, path, _sales(spark, d).schema)
    return _predictions(A.score(model, rows))


def _csv_round_trip(spark, d):
    path = scratch(spark, "csv")
    files.write_csv(load(spark, d, "documents"), path)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    back = files.read_csv(spark, path, schema=schema, multi_line=True)
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"))


def _csv_missing_markers(spark, d):
    """Numbers and texts with markers of missing values, read back with inferred types."""
    path = scratch(spark, "csv")
    price = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 'NA' WHEN o_orderkey % 7 = 1 THEN 'n/a' ELSE CAST(o_totalprice AS STRING) END")
    priority = F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'None' ELSE o_orderpriority END")
    files.write_csv(load(spark, d, "orders").select("o_orderkey", price.alias("price"), priority.alias("priority")), path)
    back = files.read_csv(spark, path)
    return back.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "price", "priority", F.typeof("price").alias("price_type"))


_CSV_MISSING_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 1 THEN o_totalprice END AS price,
CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS priority, 'double' AS price_type FROM orders"""


def _csv_quoted_breaks(spark, d):
    """Whole texts with quotes and line breaks, which the reader finds by itself."""
    path = scratch(spark, "csv")
    rows = load(spark, d, "documents").select("doc_id", F.concat("text", F.lit('\n"a, b"\n'), "lang").alias("text"))
    files.write_csv(rows, path)
    return files.read_csv(spark, path).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("digest"))


def _report_round_trip(spark, d):
    """The overview of a table, written as a report and read back."""
    from tabkit.operators.profile import table_overview
    from tabkit.sources.report import write_report

    path = scratch(spark, "report")
    write_report(table_overview(load(spark, d, "orders")), path, "json")
    return spark.read.schema("n_rows bigint, n_columns int, missing_cells bigint, columns_with_missing int").json(path)


_CUSTOMERS = ["c_acctbal", "c_nationkey"]


def _customers(spark, d):
    marked = M.assign_split(load(spark, d, "customer"), "c_custkey", 0.2)
    rows = marked.select(
        F.col("c_custkey").alias("qid"), N.vector_of(_CUSTOMERS).alias("vec"), F.ascii("c_mktsegment").cast("double").alias("label"), "is_test"
    )
    return rows.where("is_test"), rows.where("NOT is_test")


_KNN = """c AS (SELECT *, ascii(c_mktsegment)::DOUBLE AS label, row_number() OVER (ORDER BY md5('42|' || c_custkey)) <= round(count(*) OVER () * 0.2) AS is_test FROM customer),
q AS (SELECT * FROM c WHERE is_test),
p AS (SELECT c_acctbal, c_nationkey, label, count(*) AS w FROM c WHERE NOT is_test GROUP BY ALL),
d AS (SELECT q.c_custkey AS qid, p.label, p.w, {distance} AS dist FROM q, p),
o AS (SELECT *, sum(w) OVER (PARTITION BY qid ORDER BY dist, label ROWS UNBOUNDED PRECEDING) - w AS b FROM d),
n AS (SELECT qid, dist, label, least(w, 5 - b)::BIGINT AS w FROM o WHERE b < 5)"""
_EUCLIDEAN = "sqrt((q.c_acctbal - p.c_acctbal) ** 2 + (q.c_nationkey - p.c_nationkey) ** 2)"
_MANHATTAN = "abs(q.c_acctbal - p.c_acctbal) + abs(q.c_nationkey - p.c_nationkey)"


def _vote(weight: str) -> str:
    return f"""SELECT qid, label AS prediction FROM (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY sum({weight}) DESC, label) AS r
    FROM n GROUP BY qid, label) WHERE r = 1"""


def _embedded(spark, d):
    marked = M.assign_split(load(spark, d, "embeddings"), "vec_id", 0.2)
    rows = marked.select(
        F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("double").alias("label"), "is_test"
    )
    return N.knn_classify(rows.where("is_test"), rows.where("NOT is_test"), 5)


_EMBEDDED = f"""WITH c AS (SELECT vec_id, embedding::DOUBLE[] AS v, label::DOUBLE AS label,
  row_number() OVER (ORDER BY md5('42|' || vec_id)) <= round(count(*) OVER () * 0.2) AS is_test FROM embeddings),
d AS (SELECT q.vec_id AS qid, p.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, p.v), p.label) AS r
      FROM c q JOIN c p ON q.is_test AND NOT p.is_test),
n AS (SELECT qid, label, 1 AS w FROM d WHERE r <= 5) {_vote("w")}"""


def _projected(spark, d):
    """What the approximate search returns for each query: distances that an exact search confirms, nearest first."""
    queries, points = _customers(spark, d)
    found = N.approximate_neighbours(queries, points, k=5, keep_pid=True)
    real = points.select(F.xxhash64("vec", F.col("label")).alias("p"), F.col("vec").alias("v")).distinct()
    far = F.sqrt((F.col("vec")[0] - F.col("v")[0]) ** 2 + (F.col("vec")[1] - F.col("v")[1]) ** 2)
    asked = queries.select(F.col("qid").alias("q"), "vec")
    checked = found.join(asked, F.col("qid") == F.col("q")).join(real, F.col("pid") == F.col("p"))
    return checked.groupBy("qid").agg((F.sum("w") == 5).alias("finds_k"), (F.max(F.abs(far - F.col("dist"))) < 1e-9).alias("distances_are_exact"))


_PROJECTED_SQL = """SELECT c_custkey AS qid, true AS finds_k, true AS distances_are_exact
FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || c_custkey)) <= round(count(*) OVER () * 0.2) AS is_test FROM customer) WHERE is_test"""


def _projected_recall(spark, d):
    """The share of the exact neighbours that the approximate search finds."""
    queries, points = _customers(spark, d)
    exact, near = (N.nearest_neighbours(queries, points, k=5, method=m) for m in ("cells", "projections"))
    one = lambda df: df.select("qid", F.round("dist", 9).alias("dist"), "label", "w")
    met = one(exact).join(one(near).distinct(), ["qid", "dist", "label", "w"], "left_semi").count()
    return exact.agg(F.countDistinct("qid").alias("n_queries"), (F.lit(met) >= F.lit(0.9) * F.count("*")).alias("recall_is_enough"))


_PROJECTED_RECALL_SQL = "SELECT round(count(*) * 0.2)::BIGINT AS n_queries, true AS recall_is_enough FROM customer"


def _features(spark, d):
    """Entries of the feature vector, one row per order and entry."""
    df = orders_nulls(spark, d).select("o_orderkey", "o_totalprice", "o_orderpriority")
    vectors = Pipeline(stages=feature_stages(df, "o_orderkey")).fit(df).transform(df)
    names = feature_names(vectors)
    return vectors.select(
        "o_orderkey", *[F.round(vector_to_array(FEATURES)[i], 6).alias(n.replace("-", "_")) for i, n in enumerate(names)]
    )


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_FEATURES_SQL = f"""
WITH t AS (SELECT * FROM {ORDERS_NULLS}),
m AS (SELECT quantile_cont(o_totalprice, 0.5) AS med FROM t),
top AS (SELECT o_orderpriority AS v FROM t WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
f AS (SELECT o_orderkey, coalesce(o_totalprice, med) AS x, coalesce(o_orderpriority, v) AS p FROM t, m, top),
s AS (SELECT avg(x) AS mean, stddev_pop(x) AS sd FROM f)
SELECT o_orderkey, round((x - mean) / sd, 6) AS num__o_totalprice,
{", ".join(f"(p = '{v}')::INT::DOUBLE AS \"cat__o_orderpriority_{v.replace('-', '_')}\"" for v in _PRIORITIES)} FROM f, s"""

_TEXTS = [c for c, t in ORDERS_NULLS_COLUMNS.items() if t == "string"]
_DEFAULTS_SQL = f"""WITH t AS (SELECT * FROM {ORDERS_NULLS}) SELECT """ + ", ".join(
    f"(SELECT {c} FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}"
    if c in _TEXTS
    else f"(SELECT round(avg({c}), 4) FROM t) AS {c}"
    for c in ORDERS_NULLS_COLUMNS
    if c != "o_totalprice"
)


def _defaults(spark, d):
    row = A.default_row(orders_nulls(spark, d), "o_totalprice")
    return row.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in row.dtypes])


def _aligned(spark, d):
    texts = load(spark, d, "orders").selectExpr(
        "o_orderpriority", "CAST(o_totalprice AS STRING) AS o_totalprice", "CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(o_custkey AS STRING) END AS o_custkey",
        "o_orderkey",
    )
    return A.align_input(texts, load(spark, d, "orders").drop("o_orderdate", "o_orderstatus").schema)


CHECKS = {
    "feature_vectors": (_features, _FEATURES_SQL),
    "linear_regression_1d": (
        lambda s, d: _fit_one(s, d, "Linear Regression"),
        _closed_form("zy / n"),
    ),
    "ridge_1d": (lambda s, d: _fit_one(s, d, "Ridge Regression", alpha=5000.0), _closed_form("zy / (n + 5000.0)")),
    "lasso_1d": (
        lambda s, d: _fit_one(s, d, "Lasso Regression", alpha=500.0),
        _closed_form("sign(zy) * greatest(abs(zy) / n - 500.0, 0)"),
    ),
    "train_linear": (lambda s, d: _run_row(_train_sales(s, d).runs), _TEST_METRICS),
    "cross_validation": (
        lambda s, d: _train_sales(s, d, folds=5).runs.select("model", F.posexplode("cv_scores").alias("fold", "r2")).select(
            "model", "fold", F.round("r2", 6).alias("r2")
        ),
        f"WITH {_FOLD_R2} SELECT 'Linear Regression' AS model, fold::INT AS fold, round(r2, 6) AS r2 FROM r",
    ),
    "cross_validation_summary": (
        lambda s, d: _train_sales(s, d, folds=5).runs.select(
            "model", F.round("cv_mean", 6).alias("cv_mean"), F.round("cv_std", 8).alias("cv_std")
        ),
        f"WITH {_FOLD_R2} SELECT 'Linear Regression' AS model, round(avg(r2), 6) AS cv_mean, round(stddev_pop(r2), 8) AS cv_std FROM r",
    ),
    "grid_search": (lambda s, d: _search_sales(s, d, "grid"), _SEARCH_SQL),
    "random_search": (lambda s, d: _search_sales(s, d, "random", n_iter=10), _SEARCH_SQL),
    "batch_score": (_batch_score, _PREDICTED),
    "saved_model_score": (_saved_score, _PREDICTED),
    "saved_models": (
        _saved_list,
        "SELECT unnest(['Linear Regression', 'Ridge Regression']) AS model_name, 'Regression' AS problem_type, 'paid' AS target_column, '1.0' AS version",
    ),
    "stream_score": (_stream_score, _PREDICTED),
    "csv_score": (_csv_score, _PREDICTED),
    "csv_round_trip": (_csv_round_trip, "SELECT doc_id, lang, source, n_chars, md5(text) AS digest FROM documents"),
    "csv_missing_markers": (_csv_missing_markers, _CSV_MISSING_SQL),
    "csv_quoted_breaks": (
        _csv_quoted_breaks,
        """SELECT doc_id, md5(text || chr(10) || '"a, b"' || chr(10) || lang) AS digest FROM documents""",
    ),
    "report_round_trip": (
        _report_round_trip,
        "SELECT count(*) AS n_rows, 6 AS n_columns, 0::BIGINT AS missing_cells, 0 AS columns_with_missing FROM orders",
    ),
    "prediction_summary": (
        lambda s, d: A.prediction_summary(
            _sales(s, d).selectExpr("CASE WHEN price > 50000 THEN 'high' WHEN price > 20000 THEN 'mid' ELSE 'low' END AS prediction"), CLASSIFICATION
        ),
        """SELECT p AS class, count(*) AS n, round(100.0 * count(*)::DOUBLE / (SELECT count(*) FROM lineitem), 2) AS percentage
           FROM (SELECT CASE WHEN l_extendedprice > 50000 THEN 'high' WHEN l_extendedprice > 20000 THEN 'mid' ELSE 'low' END AS p FROM lineitem) GROUP BY 1""",
    ),
    "prediction_summary_regression": (
        lambda s, d: A.prediction_summary(_sales(s, d).withColumnRenamed("price", "prediction"), REGRESSION),
        union(
            f"SELECT '{n}' AS statistic, round({e}, 2) AS value FROM lineitem"
            for n, e in (
                ("mean", "avg(l_extendedprice)"), ("std", "stddev_pop(l_extendedprice)"), ("min", "min(l_extendedprice)"),
                ("max", "max(l_extendedprice)"), ("median", "quantile_cont(l_extendedprice, 0.5)"),
            )
        ),
    ),
    "default_row": (_defaults, _DEFAULTS_SQL),
    "align_input": (
        _aligned,
        """SELECT o_orderkey::DOUBLE AS o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey::DOUBLE END AS o_custkey,
           o_totalprice, o_orderpriority FROM orders""",
    ),
    "nearest_neighbours": (
        lambda s, d: N.nearest_neighbours(*_customers(s, d), k=5).withColumn("dist", F.round("dist", 6)),
        f"WITH {_KNN.format(distance=_EUCLIDEAN)} SELECT qid, round(dist, 6) AS dist, label, w FROM n",
    ),
    "nearest_neighbours_in_cells": (
        lambda s, d: N.nearest_neighbours(*_customers(s, d), k=5, block_rows=20).withColumn("dist", F.round("dist", 6)),
        f"WITH {_KNN.format(distance=_EUCLIDEAN)} SELECT qid, round(dist, 6) AS dist, label, w FROM n",
    ),
    "knn_classify": (
        lambda s, d: N.knn_classify(*_customers(s, d), k=5),
        f"WITH {_KNN.format(distance=_EUCLIDEAN)} {_vote('w')}",
    ),
    "knn_manhattan": (
        lambda s, d: N.knn_classify(*_customers(s, d), k=5, metric="manhattan"),
        f"WITH {_KNN.format(distance=_MANHATTAN)} {_vote('w')}",
    ),
    "knn_distance_weights": (
        lambda s, d: N.knn_classify(*_customers(s, d), k=5, weights="distance"),
        f"WITH {_KNN.format(distance=_EUCLIDEAN)} {_vote('w / dist')}",
    ),
    "knn_embeddings": (_embedded, _EMBEDDED),
    "knn_projections": (_projected, _PROJECTED_SQL),
    "knn_projections_recall": (_projected_recall, _PROJECTED_RECALL_SQL),
    **learned.CHECKS,
}
