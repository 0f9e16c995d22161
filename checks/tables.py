"""The given tables and variants of them, each written once for Spark and once for DuckDB.

The given tables have no nulls and no duplicate rows, so the variants derive them by expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabkit.sources.files import read_parquet

LINEITEM_NULLS_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
       CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
       l_discount, l_tax,
       CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
       l_linestatus, l_shipdate
FROM lineitem
"""

ORDERS_NULLS_SQL = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
       CAST(CAST(o_orderdate AS DATE) AS {text}) AS order_day,
       CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice ELSE NULL END AS rebate,
       CAST(1.0 AS DOUBLE) AS batch
FROM orders
"""

SCORED_BINARY_SQL = """
SELECT l_orderkey, l_linenumber, CAST(l_discount >= 0.05 AS INT) AS label,
       CAST(l_quantity > 25 AS INT) AS prediction, l_quantity / 50 AS score
FROM lineitem
"""

SCORED_CLASSES_SQL = """
SELECT o_orderpriority AS label,
       CASE WHEN o_totalprice < 100000 THEN '1-URGENT' WHEN o_totalprice < 200000 THEN '2-HIGH'
            WHEN o_totalprice < 300000 THEN '3-MEDIUM' ELSE '5-LOW' END AS prediction
FROM orders
"""

SCORED_REGRESSION_SQL = """
SELECT l_orderkey, l_linenumber, l_extendedprice AS label, 1500 * l_quantity AS prediction FROM lineitem
"""

# One run per nation and market segment, named as models: the input of the comparison operators.
RUNS_SQL = """
SELECT 'nation_' || c_nationkey AS experiment,
       'run_' || c_nationkey || '_' || c_mktsegment AS run_id,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Logistic Regression' WHEN 'BUILDING' THEN 'Decision Tree'
            WHEN 'FURNITURE' THEN 'Random Forest' WHEN 'MACHINERY' THEN 'K-Nearest Neighbors (KNN)'
            ELSE 'XGBoost' END AS model,
       '{problem}' AS problem_type,
       round(sum(abs(c_acctbal)) / 4999, 3) AS training_time_s,
       round(avg(abs(c_acctbal)) / 10007, 4) AS cv_mean,
       round(abs(avg(c_acctbal)) / 90001, 4) AS cv_std,
       round(max(abs(c_acctbal)) / 10007, 4) AS m0,
       round(avg(abs(c_acctbal)) / 9001, 4) AS m1,
       round(min(abs(c_acctbal)) / 1009, 4) AS m2,
       round(sum(abs(c_acctbal)) / 39989, 4) AS m3
FROM customer GROUP BY c_nationkey, c_mktsegment
"""

METRICS = {
    "Classification": ["accuracy", "precision", "recall", "f1_score"],
    "Regression": ["r2_score", "mae", "mse", "rmse"],
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def _over(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    """Run a variant's SELECT over one given table, registered under its own name."""
    load(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(sql)


def lineitem_nulls(spark, sf_dir):
    return _over(spark, sf_dir, "lineitem", LINEITEM_NULLS_SQL)


def orders_nulls(spark, sf_dir):
    return _over(spark, sf_dir, "orders", ORDERS_NULLS_SQL.format(text="STRING"))


def scored_binary(spark, sf_dir):
    return _over(spark, sf_dir, "lineitem", SCORED_BINARY_SQL)


def scored_classes(spark, sf_dir):
    return _over(spark, sf_dir, "orders", SCORED_CLASSES_SQL)


def scored_regression(spark, sf_dir):
    return _over(spark, sf_dir, "lineitem", SCORED_REGRESSION_SQL)


def runs(spark, sf_dir, problem="Classification"):
    names = METRICS[problem]
    entries = ", ".join(f"'{n}', m{i}" for i, n in enumerate(names))
    base = _over(spark, sf_dir, "customer", RUNS_SQL.format(problem=problem))
    return base.selectExpr(
        "experiment", "run_id", "model", "problem_type", "training_time_s", "cv_mean", "cv_std",
        f"map({entries}) AS metrics",
    )


def runs_sql(problem="Classification"):
    """The same runs for DuckDB, with one column per metric."""
    renames = ", ".join(f"m{i} AS {n}" for i, n in enumerate(METRICS[problem]))
    return (
        "SELECT experiment, run_id, model, problem_type, training_time_s, cv_mean, cv_std, "
        f"{renames} FROM ({RUNS_SQL.format(problem=problem)})"
    )


ORDERS_NULLS = f"({ORDERS_NULLS_SQL.format(text='VARCHAR')})"
LINEITEM_NULLS = f"({LINEITEM_NULLS_SQL})"
