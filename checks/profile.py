"""Checks of the profiling operators and display sources."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import functions as F

from checks.sql import LINEITEM, LINEITEM_NUMERIC, ORDERS, ORDERS_NULLS_COLUMNS, moments_corr, numeric, text, union
from checks.tables import LINEITEM_NULLS, ORDERS_NULLS, lineitem_nulls, load, orders_nulls
from tabkit.functions.kinds import kinds
from tabkit.operators import profile as P
from tabkit.sources.files import preview, stringify


def _profile_sql(relation: str, columns: dict[str, str]) -> str:
    return union(
        f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null, "
        f"count(DISTINCT {c}) AS unique_values, count(*) - count({c}) AS missing_values FROM {relation}"
        for i, (c, t) in enumerate(columns.items())
    )


def _overview_sql(relation: str, columns) -> str:
    miss = [f"(count(*) - count({c}))" for c in columns]
    flags = " + ".join(f"CASE WHEN {m} > 0 THEN 1 ELSE 0 END" for m in miss)
    return (
        f"SELECT count(*) AS n_rows, {len(miss)} AS n_columns, CAST({' + '.join(miss)} AS BIGINT) AS missing_cells, "
        f"CAST({flags} AS INT) AS columns_with_missing FROM {relation}"
    )


def _missing_sql(relation: str, columns) -> str:
    rows = union(
        f"SELECT {i} AS position, '{c}' AS column_name, count(*) - count({c}) AS missing_count, "
        f"round(100.0 * (count(*) - count({c}))::DOUBLE / count(*), 2) AS missing_percentage FROM {relation}"
        for i, c in enumerate(columns)
    )
    return f"SELECT * FROM ({rows}) WHERE missing_count > 0"


def _describe_sql(relation: str, columns, digits: int) -> str:
    return union(
        f"SELECT {i} AS position, '{c}' AS column_name, count({c}) AS n_values, "
        f"round(avg({c}), {digits}) AS mean, round(stddev_samp({c}), {digits}) AS std, "
        f"round(min({c})::DOUBLE, {digits}) AS min, "
        f"round(quantile_cont({c}::DOUBLE, 0.25), {digits}) AS q25, "
        f"round(quantile_cont({c}::DOUBLE, 0.5), {digits}) AS q50, "
        f"round(quantile_cont({c}::DOUBLE, 0.75), {digits}) AS q75, "
        f"round(max({c})::DOUBLE, {digits}) AS max FROM {relation}"
        for i, c in enumerate(columns)
    )


def _text_stats_sql(relation: str, columns) -> str:
    return union(
        f"SELECT {i} AS position, '{c}' AS column_name, (SELECT count({c}) FROM {relation}) AS n_values, "
        f"(SELECT count(DISTINCT {c}) FROM {relation}) AS unique_values, v AS most_frequent, n AS frequency FROM "
        f"(SELECT {c} AS v, count(*) AS n FROM {relation} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 1)"
        for i, c in enumerate(columns)
    )


def histogram_sql(relation: str, columns, bins: int = 30) -> str:
    def one(c):
        return f"""
SELECT '{c}' AS column_name, b.bin::INT AS bin, lo + b.bin * w AS bin_low, lo + (b.bin + 1) * w AS bin_high,
       count(x) AS n
FROM (SELECT min({c})::DOUBLE AS lo, (max({c})::DOUBLE - min({c})::DOUBLE) / {bins} AS w FROM {relation}) e
CROSS JOIN range({bins}) b(bin)
LEFT JOIN (SELECT {c}::DOUBLE AS x FROM {relation} WHERE {c} IS NOT NULL) d
  ON least(floor((x - lo) / w), {bins - 1}) = b.bin
GROUP BY b.bin, lo, w"""

    return "SELECT column_name, bin, round(bin_low, 6) AS bin_low, round(bin_high, 6) AS bin_high, n FROM (" + union(
        one(c) for c in columns
    ) + ")"


def rounded_edges(df):
    return df.withColumns({"bin_low": F.round("bin_low", 6), "bin_high": F.round("bin_high", 6)})


def _corr_sql(relation: str, pairs) -> str:
    return union(moments_corr(a, b, relation) for a, b in pairs)


def _lineitem_const(spark, d):
    return lineitem_nulls(spark, d).withColumn("batch", F.lit(1.0))


LINEITEM_CONST = f"(SELECT *, CAST(1.0 AS DOUBLE) AS batch FROM {LINEITEM_NULLS})"
_CHARGES = {
    "charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)",
    "items_sold": "-l_quantity * 2 + l_linenumber",
}
_CHARGES_SQL = f"(SELECT *, {', '.join(f'{e} AS {c}' for c, e in _CHARGES.items())} FROM {LINEITEM_NULLS})"
_NUM = [*LINEITEM_NUMERIC, "batch"]
_DUP = "(SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 10 = 0)"


def _with_duplicates(spark, d):
    lines = load(spark, d, "lineitem")
    return lines.unionByName(lines.where("l_orderkey % 10 = 0"))


_VALIDATE_SQL = f"""
WITH t AS (SELECT * FROM {ORDERS_NULLS} UNION ALL SELECT * FROM {ORDERS_NULLS} WHERE o_orderkey % 10 = 0),
n AS (SELECT count(*) AS n FROM t),
d AS (SELECT (SELECT n FROM n) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS d)
SELECT 'issue' AS severity, 'missing_values' AS code,
       'o_orderstatus, o_totalprice, o_orderpriority, rebate' AS detail
UNION ALL SELECT 'issue', 'duplicate_rows', d::VARCHAR FROM d WHERE d > 0
UNION ALL SELECT 'issue', 'very_small', n::VARCHAR FROM n WHERE n < 100
UNION ALL SELECT 'recommendation', 'large', n::VARCHAR FROM n WHERE n > 100000
UNION ALL SELECT 'recommendation', 'many_features', '8' FROM n WHERE 8 > n / 10
UNION ALL SELECT 'recommendation', 'encode_categorical', '3'
"""


def _validate_input(spark, d):
    orders = orders_nulls(spark, d)
    return orders.unionByName(orders.where("o_orderkey % 10 = 0"))


_INSIGHTS_SQL = f"""
WITH t AS (SELECT * FROM {ORDERS_NULLS}),
f AS (SELECT count(*) AS n, count(DISTINCT o_orderstatus) AS classes,
      {" + ".join(f"(count(*) - count({c}))" for c in ORDERS_NULLS_COLUMNS)} AS miss FROM t),
p AS ({_corr_sql("t", list(combinations(numeric(ORDERS_NULLS_COLUMNS), 2)))}),
s AS (SELECT count(*) AS n FROM p WHERE abs(r) > 0.7)
SELECT 'large_dataset' AS code, n::DOUBLE AS value FROM f WHERE n > 10000
UNION ALL SELECT 'small_dataset', n::DOUBLE FROM f WHERE n < 1000
UNION ALL SELECT 'high_missing', round(100.0 * miss / (n * 8), 4) FROM f WHERE 100.0 * miss / (n * 8) > 20
UNION ALL SELECT 'some_missing', round(100.0 * miss / (n * 8), 4) FROM f
  WHERE 100.0 * miss / (n * 8) > 0 AND 100.0 * miss / (n * 8) <= 20
UNION ALL SELECT 'mostly_numeric', 5
UNION ALL SELECT CASE WHEN classes = 2 THEN 'binary_target' ELSE 'multiclass_target' END, classes FROM f
UNION ALL SELECT 'strong_correlations', n FROM s WHERE n > 0
"""


def _profile_all(spark, d, names):
    """The same operator over several tables, one result."""
    out = None
    for name in names:
        part = P.column_profile(load(spark, d, name)).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_SMALL_TABLES = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
}


def _profile_all_sql(names) -> str:
    return union(
        f"SELECT *, '{n}' AS table_name FROM ({_profile_sql(n, _SMALL_TABLES[n])})" for n in names
    )


CHECKS = {
    "table_overview": (
        lambda s, d: P.table_overview(lineitem_nulls(s, d)),
        _overview_sql(LINEITEM_NULLS, LINEITEM),
    ),
    "column_profile": (
        lambda s, d: P.column_profile(load(s, d, "lineitem")),
        _profile_sql("lineitem", LINEITEM),
    ),
    "column_profile_nulls": (
        lambda s, d: P.column_profile(orders_nulls(s, d)),
        _profile_sql(ORDERS_NULLS, ORDERS_NULLS_COLUMNS),
    ),
    "column_profile_texts": (
        lambda s, d: _profile_all(s, d, ["documents", "pages", "conversations", "benchmark"]),
        _profile_all_sql(["documents", "pages", "conversations", "benchmark"]),
    ),
    "column_profile_small_tables": (
        lambda s, d: _profile_all(s, d, ["region", "nation", "customer", "supplier", "labels"]),
        _profile_all_sql(["region", "nation", "customer", "supplier", "labels"]),
    ),
    "column_profile_approx": (lambda s, d: P.column_profile(load(s, d, "lineitem"), exact=False), None),
    "validate": (lambda s, d: P.validate(_validate_input(s, d)), _VALIDATE_SQL),
    "duplicate_count": (
        lambda s, d: P.duplicate_count(_with_duplicates(s, d)),
        f"SELECT (SELECT count(*) FROM {_DUP}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_DUP})) AS duplicate_rows",
    ),
    "duplicate_count_clean": (
        lambda s, d: P.duplicate_count(load(s, d, "lineitem")),
        "SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows",
    ),
    "duplicate_count_nested": (
        lambda s, d: P.duplicate_count(load(s, d, "embeddings").withColumn("vec_id", F.floor(F.col("vec_id") / 2)).drop("label")),
        "SELECT count(*) - count(DISTINCT (vec_id // 2, embedding)) AS duplicate_rows FROM embeddings",
    ),
    "dtype_distribution": (
        lambda s, d: P.dtype_distribution(load(s, d, "lineitem")),
        """SELECT CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
           WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS data_type, count(*) AS n_columns
           FROM information_schema.columns WHERE table_name = 'lineitem' GROUP BY 1""",
    ),
    "missing_summary": (
        lambda s, d: P.missing_summary(lineitem_nulls(s, d)),
        _missing_sql(LINEITEM_NULLS, LINEITEM),
    ),
    "missing_columns": (
        lambda s, d: P.missing_columns(orders_nulls(s, d)),
        f"SELECT position, column_name FROM ({_missing_sql(ORDERS_NULLS, ORDERS_NULLS_COLUMNS)})",
    ),
    "numeric_describe": (
        lambda s, d: P.numeric_describe(lineitem_nulls(s, d), digits=4),
        _describe_sql(LINEITEM_NULLS, LINEITEM_NUMERIC, 4),
    ),
    "categorical_stats": (
        lambda s, d: P.categorical_stats(orders_nulls(s, d)),
        _text_stats_sql(ORDERS_NULLS, text(ORDERS_NULLS_COLUMNS)),
    ),
    "categorical_describe": (
        lambda s, d: P.categorical_describe(load(s, d, "documents"), "text"),
        f"SELECT column_name, n_values, unique_values, most_frequent, frequency FROM ({_text_stats_sql('documents', ['text'])})",
    ),
    "top_values": (
        lambda s, d: P.top_values(load(s, d, "events"), "props"),
        "SELECT props AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
    ),
    "histogram": (
        lambda s, d: rounded_edges(P.histogram(load(s, d, "events"), "value")),
        histogram_sql("events", ["value"]),
    ),
    "histogram_all_columns": (
        lambda s, d: rounded_edges(P.histogram(lineitem_nulls(s, d), LINEITEM_NUMERIC)),
        histogram_sql(LINEITEM_NULLS, LINEITEM_NUMERIC),
    ),
    "correlation_matrix": (
        lambda s, d: P.correlation_matrix(_lineitem_const(s, d)).withColumn("corr", F.round("corr", 6)),
        f"SELECT col_a, col_b, round(r, 6) AS corr FROM ({_corr_sql(LINEITEM_CONST, list(product(_NUM, _NUM)))})",
    ),
    "strong_pairs": (
        lambda s, d: P.strong_pairs(lineitem_nulls(s, d).selectExpr("*", *[f"{e} AS {c}" for c, e in _CHARGES.items()])),
        f"SELECT col_a, col_b, round(r, 3) AS corr FROM ({_corr_sql(_CHARGES_SQL, list(combinations([*LINEITEM_NUMERIC, *_CHARGES], 2)))}) WHERE abs(r) > 0.7",
    ),
    "top_target_correlates": (
        lambda s, d: P.top_target_correlates(lineitem_nulls(s, d), "l_extendedprice").select(
            "column_name", F.round("corr", 6).alias("corr")
        ),
        f"""SELECT col_a AS column_name, round(r, 6) AS corr FROM
        ({_corr_sql(LINEITEM_NULLS, [(c, "l_extendedprice") for c in LINEITEM_NUMERIC if c != "l_extendedprice"])})
        ORDER BY abs(r) DESC, col_a LIMIT 5""",
    ),
    "weak_features": (
        lambda s, d: P.weak_features(lineitem_nulls(s, d), "l_extendedprice").select(
            "column_name", F.round("corr", 6).alias("corr")
        ),
        f"""SELECT col_a AS column_name, round(r, 6) AS corr FROM
        ({_corr_sql(LINEITEM_NULLS, [(c, "l_extendedprice") for c in LINEITEM_NUMERIC if c != "l_extendedprice"])})
        WHERE abs(r) < 0.1 ORDER BY abs(r) DESC, col_a LIMIT 3""",
    ),
    "high_cardinality": (
        lambda s, d: P.high_cardinality(load(s, d, "documents")),
        "SELECT * FROM ("
        + union(
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS unique_values, round(count(DISTINCT {c})::DOUBLE / count(*), 4) AS unique_ratio FROM documents"
            for c in ("text", "lang", "source")
        )
        + ") WHERE unique_ratio > 0.5",
    ),
    "pair_sample": (
        lambda s, d: P.pair_sample(load(s, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]),
        """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem
           ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey) LIMIT 1000""",
    ),
    "target_distribution": (
        lambda s, d: P.target_distribution(orders_nulls(s, d), "o_orderpriority"),
        f"""SELECT o_orderpriority AS value, count(*) AS n,
            round(100.0 * count(*)::DOUBLE / (SELECT count(*) FROM orders), 2) AS percentage
            FROM {ORDERS_NULLS} WHERE o_orderpriority IS NOT NULL GROUP BY 1""",
    ),
    "target_distribution_numeric": (
        lambda s, d: P.target_distribution(load(s, d, "events"), "value"),
        _describe_sql("events", ["value"], 2),
    ),
    "target_counts": (
        lambda s, d: P.target_counts(orders_nulls(s, d), "o_orderpriority"),
        f"""SELECT 'o_orderpriority' AS column_name, count(DISTINCT o_orderpriority) AS unique_values,
            count(*) - count(o_orderpriority) AS missing_values FROM {ORDERS_NULLS}""",
    ),
    "insights": (lambda s, d: P.insights(orders_nulls(s, d), "o_orderstatus"), _INSIGHTS_SQL),
    "preview": (
        lambda s, d: preview(load(s, d, "orders"), "o_orderkey"),
        "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10",
    ),
    "stringify": (
        lambda s, d: stringify(orders_nulls(s, d).withColumn("pair", F.array("o_orderkey", "o_custkey"))),
        f"""SELECT * REPLACE (coalesce(o_orderstatus, 'nan') AS o_orderstatus,
            coalesce(o_orderpriority, 'nan') AS o_orderpriority),
            '[' || o_orderkey || ',' || o_custkey || ']' AS pair FROM {ORDERS_NULLS}""",
    ),
}
