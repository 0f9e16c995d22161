"""Checks of column hygiene, missing values, outliers, encoding and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.profile import histogram_sql, rounded_edges
from checks.sql import LINEITEM, LINEITEM_NUMERIC, ORDERS, ORDERS_NULLS_COLUMNS, numeric, text, union
from checks.tables import LINEITEM_NULLS, ORDERS_NULLS, lineitem_nulls, load, orders_nulls
from tabkit.operators import encode as E
from tabkit.operators import hygiene as H


def _unwanted_sql(relation: str, columns: dict[str, str], target: str | None = None) -> str:
    pattern = "(" + "|".join(H.ID_NAME_PATTERNS) + ")"
    parts = []
    for c, t in columns.items():
        if c == target:
            continue
        num, integral, txt = t in ("bigint", "int", "double"), t in ("bigint", "int"), t == "string"
        x = f"{c}::DOUBLE" if num else "NULL::DOUBLE"
        steps = f"SELECT lead(v) OVER (ORDER BY v) - v AS step FROM (SELECT {x} AS v FROM {relation} WHERE {c} IS NOT NULL)"
        parts.append(f"""
SELECT '{c}' AS column_name, count(*) AS n, count({c}) AS nn, count(DISTINCT {c}) AS u,
  {str(num).lower()} AS num, {str(integral).lower()} AS integ, {str(txt).lower()} AS txt,
  (SELECT bool_and(step = 1) FROM ({steps}) WHERE step IS NOT NULL) AS ones,
  (SELECT avg(step) FROM ({steps}) WHERE step IS NOT NULL) AS mean_step,
  {f"bool_and(regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) FILTER ({c} IS NOT NULL)" if txt else "NULL::BOOLEAN"} AS dates
FROM {relation}""")
    return f"""
WITH s AS ({union(parts)})
SELECT column_name, 'id_like_name' AS reason, 1.0::DOUBLE AS value FROM s WHERE regexp_matches(column_name, '{pattern}', 'i')
UNION ALL SELECT column_name, 'uniqueness_gt_95', round(u / n::DOUBLE, 6) FROM s WHERE u / n::DOUBLE > 0.95
UNION ALL SELECT column_name, 'uniqueness_gt_90', round(u / n::DOUBLE, 6) FROM s WHERE u / n::DOUBLE > 0.90 AND u / n::DOUBLE <= 0.95
UNION ALL SELECT column_name, 'sequential', 1.0 FROM s WHERE num AND u = n AND ones
UNION ALL SELECT column_name, 'increasing_sequence', round(mean_step, 6) FROM s WHERE num AND u = n AND NOT ones AND mean_step < 100
UNION ALL SELECT column_name, 'high_cardinality_integer', u FROM s WHERE integ AND u > 1000 AND u / n::DOUBLE > 0.8
UNION ALL SELECT column_name, 'constant', u FROM s WHERE u = 1
UNION ALL SELECT column_name, 'high_cardinality_text', u FROM s WHERE txt AND u > 100
UNION ALL SELECT column_name, 'mostly_missing', round((n - nn) / n::DOUBLE, 6) FROM s WHERE (n - nn) / n::DOUBLE > 0.7
UNION ALL SELECT column_name, 'date_string', 1.0 FROM s WHERE dates
"""


def _fences(column: str, relation: str) -> str:
    return (
        f"SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({column}::DOUBLE, 0.25) AS q1, "
        f"quantile_cont({column}::DOUBLE, 0.75) AS q3 FROM {relation})"
    )


_REMOVE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _skewed(spark, d):
    """Two right-skewed columns of events, the second a function of the first and the key."""
    return load(spark, d, "events").selectExpr(
        "event_id", "value", "value * value AS squared", "value * (event_id % 7) AS weighted"
    )


_SKEWED = "(SELECT event_id, value, value * value AS squared, value * (event_id % 7) AS weighted FROM events)"


def _removal_sql(columns) -> str:
    steps, source = [], _SKEWED
    for i, c in enumerate(columns):
        steps.append(
            f"b{i} AS ({_fences(c, source)}), t{i} AS (SELECT t.* FROM {source} t, b{i} "
            f"WHERE {c} IS NULL OR ({c} >= lo AND {c} <= hi))"
        )
        source = f"t{i}"
    return "WITH " + ", ".join(steps) + f" SELECT * FROM {source}"


def _median(c):
    return f"coalesce({c}::DOUBLE, (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM t)) AS {c}"


def _mode(c):
    return f"coalesce({c}, (SELECT {c} FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}"


def _replace_sql(relation: str, items) -> str:
    return f"WITH t AS (SELECT * FROM {relation}) SELECT * REPLACE ({', '.join(items)}) FROM t"


def _codes(c, relation, null="'nan'"):
    return f"(SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce({c}, {null}) AS v FROM {relation}))"


def _first_seen(c, relation, key):
    return f"(SELECT {c} AS v, row_number() OVER (ORDER BY min({key})) - 1 AS code FROM {relation} WHERE {c} IS NOT NULL GROUP BY {c})"


_ONE_HOT_VALUES = {
    "o_orderstatus": ["F", "O", "P"],
    "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
}
_ONE_HOT_SQL = (
    "SELECT o_orderkey, "
    + ", ".join(
        f"coalesce({c} = '{v}', false) AS \"{c}_{v}\"" for c, values in _ONE_HOT_VALUES.items() for v in values
    )
    + f" FROM {ORDERS_NULLS}"
)

_CLEAN_SQL = f"""
WITH t AS (SELECT * FROM {ORDERS_NULLS}),
f AS (SELECT * REPLACE ({_mode("o_orderstatus")}, {_mode("o_orderpriority")}, {_median("o_totalprice")}, {_median("rebate")}) FROM t)
SELECT o_custkey, o_orderkey, s.code AS o_orderstatus, o_totalprice, o_orderpriority, d.code AS order_day, rebate, batch
FROM f JOIN {_first_seen("o_orderstatus", "f", "o_orderkey")} s ON f.o_orderstatus = s.v
JOIN {_first_seen("order_day", "f", "o_orderkey")} d ON f.order_day = d.v
"""


def _clean_input(spark, d):
    """A column named like an identifier is there to be dropped."""
    return orders_nulls(spark, d).withColumn("customer_ref", F.col("o_custkey"))


def _rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _handled(spark, d):
    """Outliers removed and capped, with the number that was handled and what is left."""
    rows = load(spark, d, "events").select("event_id", "value")
    out = []
    for method in ("remove", "cap"):
        cleaned, n = H.handle_outliers(rows, method, ["value"])
        left = cleaned.agg(F.count("*"), F.round(F.min("value"), 6), F.round(F.max("value"), 6)).first()
        out.append((method, int(n), *left))
    return spark.createDataFrame(out, "method string, handled long, n_rows long, low double, high double")


_HANDLED_SQL = """
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events),
f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q),
t AS (SELECT value, value < lo OR value > hi AS far, least(greatest(value, lo), hi) AS cut FROM events, f)
SELECT 'remove' AS method, count(*) FILTER (far) AS handled, count(*) FILTER (NOT far) AS n_rows,
       round(min(value) FILTER (NOT far), 6) AS low, round(max(value) FILTER (NOT far), 6) AS high FROM t
UNION ALL SELECT 'cap', count(*) FILTER (far), count(*), round(min(cut), 6), round(max(cut), 6) FROM t
"""

CHECKS = {
    "detect_unwanted": (
        lambda s, d: H.detect_unwanted(orders_nulls(s, d), "o_totalprice"),
        _unwanted_sql(ORDERS_NULLS, ORDERS_NULLS_COLUMNS, "o_totalprice"),
    ),
    "detect_unwanted_lineitem": (
        lambda s, d: H.detect_unwanted(load(s, d, "lineitem")),
        _unwanted_sql("lineitem", LINEITEM),
    ),
    "detect_unwanted_documents": (
        lambda s, d: H.detect_unwanted(load(s, d, "documents")),
        _unwanted_sql(
            "documents", {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
        ),
    ),
    "drop_columns": (
        lambda s, d: H.drop_columns(load(s, d, "orders"), ["o_orderdate", "not_there"]),
        "SELECT * EXCLUDE (o_orderdate) FROM orders",
    ),
    "drop_id_columns": (
        lambda s, d: H.drop_id_columns(load(s, d, "events"), "value"),
        "SELECT * EXCLUDE (event_id, user_id) FROM events",
    ),
    "impute_mean": (
        lambda s, d: _rounded(H.impute_mean(lineitem_nulls(s, d)), ["l_quantity", "l_extendedprice"]),
        _replace_sql(
            LINEITEM_NULLS,
            [f"round(coalesce({c}, (SELECT avg({c}) FROM t)), 6) AS {c}" for c in ("l_quantity", "l_extendedprice")],
        ),
    ),
    "impute_median": (
        lambda s, d: H.impute_median(lineitem_nulls(s, d)),
        _replace_sql(LINEITEM_NULLS, [_median("l_quantity"), _median("l_extendedprice")]),
    ),
    "impute_mode": (
        lambda s, d: H.impute_mode(lineitem_nulls(s, d)),
        _replace_sql(LINEITEM_NULLS, [_mode("l_quantity"), _mode("l_extendedprice"), _mode("l_returnflag")]),
    ),
    "drop_missing": (
        lambda s, d: H.drop_missing(lineitem_nulls(s, d)),
        f"SELECT * FROM {LINEITEM_NULLS} WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL",
    ),
    "iqr_outliers": (
        lambda s, d: H.iqr_outliers(load(s, d, "events"), "value"),
        f"SELECT e.* FROM events e, ({_fences('value', 'events')}) WHERE value < lo OR value > hi",
    ),
    "zscore_outliers": (
        lambda s, d: H.zscore_outliers(load(s, d, "events"), "value"),
        "SELECT e.* FROM events e, (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events) WHERE abs((value - m) / sd) > 3",
    ),
    "outlier_counts": (
        lambda s, d: H.outlier_counts(lineitem_nulls(s, d), "l_tax"),
        union(
            f"SELECT '{c}' AS column_name, count(*) FILTER ({c} < lo OR {c} > hi) AS outliers FROM {LINEITEM_NULLS}, ({_fences(c, LINEITEM_NULLS)})"
            for c in LINEITEM_NUMERIC
            if c != "l_tax"
        ),
    ),
    "remove_outliers": (
        lambda s, d: H.remove_outliers(_skewed(s, d), ["value", "squared", "weighted"]),
        _removal_sql(["value", "squared", "weighted"]),
    ),
    "remove_outliers_independent": (
        lambda s, d: H.remove_outliers(_skewed(s, d), ["value", "squared"], sequential=False),
        f"""SELECT t.* FROM {_SKEWED} t, ({_fences("value", _SKEWED)}) a, ({_fences("squared", _SKEWED)}) b
            WHERE value BETWEEN a.lo AND a.hi AND squared BETWEEN b.lo AND b.hi""",
    ),
    "cap_outliers": (
        lambda s, d: H.cap_outliers(_skewed(s, d), ["value", "squared"]),
        f"""SELECT t.* REPLACE (least(greatest(value, a.lo), a.hi) AS value, least(greatest(squared, b.lo), b.hi) AS squared)
            FROM {_SKEWED} t, ({_fences("value", _SKEWED)}) a, ({_fences("squared", _SKEWED)}) b""",
    ),
    "clean_all": (lambda s, d: H.clean_all(_clean_input(s, d), ["o_orderkey"], "o_orderpriority"), _CLEAN_SQL),
    "compare_distribution": (
        lambda s, d: rounded_edges(
            H.compare_distribution(load(s, d, "events"), H.cap_outliers(load(s, d, "events"), ["value"]), "value")
        ),
        f"""WITH c AS (SELECT least(greatest(value, lo), hi) AS value FROM events, ({_fences("value", "events")}))
        SELECT *, 'before' AS side FROM ({histogram_sql("events", ["value"])})
        UNION ALL SELECT *, 'after' AS side FROM ({histogram_sql("c", ["value"])})""",
    ),
    "frames_equal": (
        lambda s, d: s.createDataFrame(
            [
                ("same", H.frames_equal(load(s, d, "orders"), load(s, d, "orders").repartition(3))),
                ("changed", H.frames_equal(load(s, d, "orders"), load(s, d, "orders").where("o_orderkey <> 1"))),
            ],
            "pair string, equal boolean",
        ),
        """SELECT 'same' AS pair, NOT EXISTS (SELECT * FROM orders EXCEPT ALL SELECT * FROM orders) AS equal
           UNION ALL SELECT 'changed', NOT EXISTS (SELECT * FROM orders EXCEPT ALL SELECT * FROM orders WHERE o_orderkey <> 1)""",
    ),
    "label_encode": (
        lambda s, d: E.label_encode(orders_nulls(s, d).drop("order_day"), target="o_orderstatus"),
        f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, p.code AS o_orderpriority, rebate, batch
            FROM {ORDERS_NULLS} t JOIN {_codes("o_orderpriority", ORDERS_NULLS)} p ON coalesce(t.o_orderpriority, 'nan') = p.v""",
    ),
    "one_hot_long": (
        lambda s, d: E.one_hot_long(load(s, d, "documents").select("doc_id", "text", "lang", "source"), "doc_id"),
        union(
            f"""SELECT doc_id, '{c}' AS column_name, (x.code + {before})::BIGINT AS position FROM documents t JOIN {_codes(c, "documents")} x ON t.{c} = x.v"""
            for c, before in (
                ("text", "0"), ("lang", "(SELECT count(DISTINCT text) FROM documents)"),
                ("source", "(SELECT count(DISTINCT text) + count(DISTINCT lang) FROM documents)"),
            )
        ),
    ),
    "handled_outliers": (_handled, _HANDLED_SQL),
    "label_encode_texts": (
        lambda s, d: E.label_encode(load(s, d, "documents"), ["text", "lang"]).select("doc_id", "text", "lang"),
        f"""SELECT doc_id, x.code AS text, l.code AS lang FROM documents t
            JOIN {_codes("text", "documents")} x ON t.text = x.v JOIN {_codes("lang", "documents")} l ON t.lang = l.v""",
    ),
    "one_hot": (
        lambda s, d: E.one_hot(orders_nulls(s, d).select("o_orderkey", "o_orderstatus", "o_orderpriority")),
        _ONE_HOT_SQL,
    ),
    "factorize": (
        lambda s, d: E.factorize(orders_nulls(s, d), "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority"),
        f"""SELECT o_orderkey, coalesce(p.code, -1) AS o_orderpriority FROM {ORDERS_NULLS} t
            LEFT JOIN {_first_seen("o_orderpriority", ORDERS_NULLS, "o_orderkey")} p ON t.o_orderpriority = p.v""",
    ),
    "factorize_texts": (
        lambda s, d: E.factorize(load(s, d, "documents"), "text", "doc_id").select("doc_id", "text"),
        f"""SELECT doc_id, p.code AS text FROM documents t
            JOIN {_first_seen("text", "documents", "doc_id")} p ON t.text = p.v""",
    ),
    "standard_scale": (
        lambda s, d: _rounded(
            E.standard_scale(lineitem_nulls(s, d).withColumn("batch", F.lit(1.0)), [*LINEITEM_NUMERIC, "batch"]),
            LINEITEM_NUMERIC,
        ),
        _replace_sql(
            f"(SELECT *, 0.0::DOUBLE AS batch FROM {LINEITEM_NULLS})",
            [
                f"round(({c} - (SELECT avg({c}) FROM t)) / (SELECT stddev_pop({c}) FROM t), 6) AS {c}"
                for c in LINEITEM_NUMERIC
            ],
        ),
    ),
    "minmax_scale": (
        lambda s, d: _rounded(E.minmax_scale(lineitem_nulls(s, d), LINEITEM_NUMERIC), LINEITEM_NUMERIC),
        _replace_sql(
            LINEITEM_NULLS,
            [
                f"round(({c} - (SELECT min({c}) FROM t)) / (SELECT max({c}) - min({c}) FROM t), 6) AS {c}"
                for c in LINEITEM_NUMERIC
            ],
        ),
    ),
    "encode_target": (
        lambda s, d: E.encode_target(load(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority"),
        f"SELECT o_orderkey, p.code AS o_orderpriority FROM orders JOIN {_codes('o_orderpriority', 'orders')} p ON o_orderpriority = p.v",
    ),
    "decode_target": (
        lambda s, d: E.decode_target(
            load(s, d, "orders").selectExpr("o_orderkey", "CAST(o_orderkey % 5 AS DOUBLE) AS prediction"),
            "prediction",
            E.target_codes(load(s, d, "orders"), "o_orderpriority"),
        ),
        f"SELECT o_orderkey, p.v AS prediction FROM orders JOIN {_codes('o_orderpriority', 'orders')} p ON o_orderkey % 5 = p.code",
    ),
}
