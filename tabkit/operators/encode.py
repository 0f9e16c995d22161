"""Encoding and scaling of whole tables. Dictionaries of values stay distributed until their size is known."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.functions.kinds import as_double, col, numeric_columns, text_columns
from tabkit.functions.ranking import BROADCAST_ROWS, fetched, with_position
from tabkit.functions.stats import fingerprint, finite_or_null
from tabkit.session import cut_lineage, shared_table

BROADCAST_BYTES = 64 << 20
SORTED_TEXTS = 100_000
HOT_VALUES = 1000


def join_dictionary(
    df: DataFrame, column: Column, dictionary: DataFrame, name: str, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Left join ``dictionary(value, code, n)`` and name the code.

    A small dictionary, by its rows and its bytes, is broadcast. A large one is split: its most frequent values are
    broadcast, and rows that have one, or none, are coded where they are. Only the other rows are shuffled; none of
    their values is frequent, so none can crowd a task.
    """
    keyed = df.withColumn("_v", column)
    length = F.octet_length(F.concat(F.col("value").cast("string"), F.col("code").cast("string")))
    size, volume = dictionary.agg(F.count(F.lit(1)), F.sum(length)).first()
    found = dictionary.select(F.col("value").alias("_w"), F.col("code").alias(name))
    if size <= broadcast_rows and (volume or 0) <= BROADCAST_BYTES:
        return keyed.join(F.broadcast(found), F.col("_v") == F.col("_w"), "left").drop("_v", "_w")
    hot = dictionary.orderBy(F.desc("n"), "value").limit(HOT_VALUES).select(F.col("value").alias("_w"), F.col("code").alias(name))
    hot = F.broadcast(shared_table(hot, "hot-values"))
    coded = keyed.join(hot, F.col("_v") == F.col("_w"), "left")
    settled = coded.where(F.col("_w").isNotNull() | F.col("_v").isNull())
    cold = keyed.join(hot, F.col("_v") == F.col("_w"), "left_anti").where(F.col("_v").isNotNull())
    rest = cold.join(found.join(hot.select(F.col("_w").alias("_hot")), F.col("_w") == F.col("_hot"), "left_anti"), F.col("_v") == F.col("_w"), "left")
    return settled.unionByName(rest).drop("_v", "_w")


def _stored_between(df: DataFrame, dictionary: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as it is, or stored where the next dictionary is a large one: each of those reads its input twice."""
    return shared_table(df, "coded") if dictionary.limit(broadcast_rows + 1).count() > broadcast_rows else df


def _coded(seen: DataFrame, *order: str) -> DataFrame:
    """``(value, code, n)`` with codes in the given order and long values as digests, computed once.

    The digests keep a dictionary row short, so a dictionary below the row limit is small in bytes too.
    """
    placed = with_position(seen, list(order), "code", one_task_rows=SORTED_TEXTS)
    placed = placed.select(fingerprint(F.col("value")).alias("value"), "code", "n")
    local = fetched(placed)
    return cut_lineage(placed) if local is None else local


def _replace(df: DataFrame, codes: dict[str, str]) -> DataFrame:
    order = [col(codes[c]).alias(c) if c in codes else col(c) for c in df.columns if c not in codes.values()]
    return df.select(*order)


def label_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code, n): distinct texts in sorted order -> 0..k-1; null counts as the text 'nan'.

    ``value`` is the fingerprint of the text.
    """
    text = F.coalesce(col(column).cast("string"), F.lit("nan"))
    return _coded(df.groupBy(text.alias("value")).agg(F.count(F.lit(1)).alias("n")), "value")


def label_encode(df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None) -> DataFrame:
    """Replace texts by their rank among the sorted distinct texts of the column; the target is skipped."""
    columns = list(columns) if columns is not None else text_columns(df)
    codes = {}
    source = df
    for i, c in enumerate(c for c in columns if c != target and c in df.columns):
        text = F.coalesce(col(c).cast("string"), F.lit("nan"))
        dictionary = label_dictionary(source, c)
        df = join_dictionary(_stored_between(df, dictionary) if i else df, fingerprint(text), dictionary, f"_code{i}")
        codes[c] = f"_code{i}"
    return _replace(df, codes)


def target_codes(df: DataFrame, target: str) -> DataFrame:
    """(value, code): the sorted classes of a target, to encode and decode it."""
    distinct = df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("value"))
    return with_position(distinct.agg(F.count(F.lit(1)).alias("n")), ["value"], "code").select("value", "code")


def encode_target(df: DataFrame, target: str) -> DataFrame:
    codes = target_codes(df, target).withColumn("n", F.lit(0))
    coded = join_dictionary(df, col(target).cast("string"), codes, "_code")
    return _replace(coded, {target: "_code"})


def decode_target(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Codes back to classes. ``codes`` is the (value, code) table of ``target_codes``."""
    back = codes.select(F.col("code").alias("value"), F.col("value").alias("code"), F.lit(0).alias("n"))
    decoded = join_dictionary(df, col(column).cast("long"), back, "_class")
    return _replace(decoded, {column: "_class"})


def one_hot(
    df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None, max_categories: int = 1000
) -> DataFrame:
    """One boolean column ``column_value`` per value, none dropped; null is false in all of them.

    The result is as wide as the number of values, so more than ``max_categories`` is an error.
    """
    columns = [c for c in (list(columns) if columns is not None else text_columns(df)) if c != target]
    found: dict[str, list[str]] = {}
    for c in columns:
        values = df.where(col(c).isNotNull()).select(col(c).cast("string").alias("v")).distinct()
        rows = values.limit(max_categories + 1).collect()
        if len(rows) > max_categories:
            raise ValueError(f"column {c!r} has more than {max_categories} values; drop it or use label_encode")
        found[c] = sorted(r["v"] for r in rows)
    kept = [col(c) for c in df.columns if c not in found]
    flags = [
        F.coalesce(col(c).cast("string") == F.lit(v), F.lit(False)).alias(f"{c}_{v}") for c in columns for v in found[c]
    ]
    return df.select(*kept, *flags)


def one_hot_long(
    df: DataFrame, key: str | Sequence[str], columns: Sequence[str] | None = None, target: str | None = None, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """(key, column_name, position): the ones of a one-hot table, one row per row and column that has a value.

    ``position`` numbers the values of all columns in the order of ``columns`` and, within a column, of its sorted texts.
    The dictionaries stay distributed, so the number of values has no limit; null gives no row.
    """
    key = [key] if isinstance(key, str) else list(key)
    columns = [c for c in (list(columns) if columns is not None else text_columns(df)) if c != target and c not in key]
    parts, start = [], 0
    for c in columns:
        text = df.where(col(c).isNotNull()).select(*[col(k) for k in key], col(c).cast("string").alias("_text"))
        seen = text.groupBy(F.col("_text").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        dictionary = _coded(seen, "value")
        coded = join_dictionary(text, fingerprint(F.col("_text")), dictionary, "_code", broadcast_rows)
        parts.append(coded.select(*[col(k) for k in key], F.lit(c).alias("column_name"), (F.col("_code") + F.lit(start)).alias("position")))
        start += dictionary.count()
    if not parts:
        return df.select(*[col(k) for k in key], F.lit("").alias("column_name"), F.lit(0).cast("long").alias("position")).limit(0)
    return reduce(DataFrame.unionByName, parts)


def factorize(df: DataFrame, columns: str | Sequence[str], order_key: str | Sequence[str]) -> DataFrame:
    """Replace values by 0, 1, ... in order of first appearance along ``order_key``; null becomes -1."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    order = [order_key] if isinstance(order_key, str) else list(order_key)
    source, codes = df, {}
    for i, c in enumerate(columns):
        place = col(order[0]) if len(order) == 1 else F.struct(*[col(k).alias(f"k{j}") for j, k in enumerate(order)])
        seen = (
            source.where(col(c).isNotNull())
            .groupBy(col(c).cast("string").alias("value"))
            .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        )
        dictionary = _coded(seen, "first", "value")
        df = join_dictionary(_stored_between(df, dictionary) if i else df, fingerprint(col(c).cast("string")), dictionary, f"_code{i}")
        df = df.withColumn(f"_code{i}", F.coalesce(F.col(f"_code{i}"), F.lit(-1).cast("long")))
        codes[c] = f"_code{i}"
    return _replace(df, codes)


def _scale(df: DataFrame, columns: Sequence[str], centre, spread) -> DataFrame:
    """(x - centre) / spread with both as literals; no spread gives 0, null stays null."""
    stats = [f(finite_or_null(c)) for c in columns for f in (centre, spread)]
    row = df.agg(*[s.alias(f"s{i}") for i, s in enumerate(stats)]).first() if columns else []
    scaled = {}
    for i, c in enumerate(columns):
        middle, width = row[2 * i], row[2 * i + 1]
        x = as_double(c)
        scaled[c] = (x - F.lit(middle)) / F.lit(width) if width else F.when(x.isNotNull(), F.lit(0.0))
    return df.select(*[scaled[c].alias(c) if c in scaled else col(c) for c in df.columns])


def _scaled_columns(df, columns, target):
    return [c for c in (list(columns) if columns is not None else numeric_columns(df)) if c != target]


def standard_scale(df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None) -> DataFrame:
    """(x - mean) / population standard deviation; the target is skipped."""
    return _scale(df, _scaled_columns(df, columns, target), F.avg, F.stddev_pop)


def minmax_scale(df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None) -> DataFrame:
    """(x - min) / (max - min); the target is skipped."""
    return _scale(df, _scaled_columns(df, columns, target), F.min, lambda x: F.max(x) - F.min(x))
