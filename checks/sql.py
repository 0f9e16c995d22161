"""Small builders for the DuckDB side of the checks."""

from __future__ import annotations

LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
ORDERS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}
ORDERS_NULLS_COLUMNS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderpriority": "string", "order_day": "string", "rebate": "double", "batch": "double",
}
LINEITEM_NUMERIC = [c for c, t in LINEITEM.items() if t in ("bigint", "int", "double")]
NUMERIC_TYPES = ("bigint", "int", "double")


def numeric(columns: dict[str, str]) -> list[str]:
    return [c for c, t in columns.items() if t in NUMERIC_TYPES]


def text(columns: dict[str, str]) -> list[str]:
    return [c for c, t in columns.items() if t == "string"]


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def moments_corr(a: str, b: str, relation: str) -> str:
    """Pearson over complete pairs, NULL where it is undefined."""
    return (
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
        f"CASE WHEN isnan(corr({a}::DOUBLE, {b}::DOUBLE)) THEN NULL ELSE corr({a}::DOUBLE, {b}::DOUBLE) END AS r "
        f"FROM {relation}"
    )
