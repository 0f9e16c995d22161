"""Aggregate expressions whose definitions differ from Spark's built-ins, and exact value counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.functions.kinds import (
    BOOLEAN, DATETIME, NESTED, NUMERIC, TEXT, as_double, col, is_floating, is_integral, kind_of,
)

LONG_TEXT = 64
TIED_DIGESTS = 100_000


def adjusted_skewness(x: Column) -> Column:
    """Bias-adjusted skewness (G1); null below three values or without variance."""
    n = F.count(x).cast("double")
    g1 = F.try_divide(F.skewness(x) * F.sqrt(n * (n - 1)), n - 2)
    return F.when((n > 2) & (F.max(x) > F.min(x)), g1)


def adjusted_kurtosis(x: Column) -> Column:
    """Bias-adjusted excess kurtosis (G2); null below four values or without variance."""
    n = F.count(x).cast("double")
    g2 = F.try_divide((n - 1) * ((n + 1) * F.kurtosis(x) + 6), (n - 2) * (n - 3))
    return F.when((n > 3) & (F.max(x) > F.min(x)), g2)


def skew_class(skewness: Column) -> Column:
    return (
        F.when(F.abs(skewness) > 1, "Highly Skewed")
        .when(F.abs(skewness) > 0.5, "Moderately Skewed")
        .otherwise("Approximately Normal")
    )


def fingerprint(text: Column) -> Column:
    """The text itself, or for a long one its first characters, its digest and its length.

    That is longer than ``LONG_TEXT`` bytes, so no short text can look like the fingerprint of a long one.
    """
    digest = F.concat(F.left(text, F.lit(10)), F.lit(":"), F.sha2(text, 256), F.lit(":"), F.octet_length(text).cast("string"))
    return F.when(F.octet_length(text) > LONG_TEXT, digest).otherwise(text)


def _typed(field: T.StructField, fingerprints: bool) -> tuple[Column, Column, Column]:
    """The value of a column in the slot of its type: whole number, fraction or text."""
    c, kind = col(field.name), kind_of(field.dataType)
    whole, fraction, text = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if is_integral(field.dataType) or kind == BOOLEAN:
        whole = c.cast("long")
    elif is_floating(field.dataType):
        fraction = c.cast("double")
    elif kind == NUMERIC:
        fraction, text = c.cast("double"), c.cast("string")
    elif kind == DATETIME:
        whole = F.unix_date(c).cast("long") if isinstance(field.dataType, T.DateType) else F.unix_micros(c.cast("timestamp"))
    elif kind == TEXT:
        text = c.cast("string")
        if fingerprints:
            text = fingerprint(text)
    elif kind == NESTED:
        whole = F.when(c.isNotNull(), F.lit(1).cast("long"))
    return whole, fraction, text


def _slots(field: T.StructField) -> tuple[str, ...]:
    """Which of the three typed columns hold the value; a decimal uses its exact text and its size."""
    kind = kind_of(field.dataType)
    if is_floating(field.dataType):
        return ("fraction",)
    if kind == TEXT:
        return ("text",)
    if kind == NUMERIC and not is_integral(field.dataType):
        return ("fraction", "text")
    return ("whole",)


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, fingerprints: bool = False) -> DataFrame:
    """``(i, whole, fraction, text, n)``: the rows per column number and value, nulls included.

    Columns of one value type share a scan and a shuffle with keys of that type, so a columnar table is read
    once in total, and every distinct count, mode and share follows from the result. Copies of a value are
    counted before the shuffle: a value that fills a third of the table travels once per task.
    ``fingerprints`` replaces long texts by a digest: enough to count them, much less to move.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    if columns is not None:
        fields.sort(key=lambda f: list(columns).index(f.name))
    types = {"whole": "long", "fraction": "double", "text": "string"}
    by_slots: dict[tuple[str, ...], list] = {}
    for i, f in enumerate(fields):
        by_slots.setdefault(_slots(f), []).append((i, dict(zip(types, _typed(f, fingerprints)))))
    parts = []
    for slots, members in by_slots.items():
        args = [x for i, typed in members for x in (F.lit(i), *[typed[s] for s in slots])]
        long = df.select(F.stack(F.lit(len(members)), *args).alias("i", *slots))
        counted = long.groupBy("i", *slots).agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            counted.select(
                "i", *[F.col(s) if s in slots else F.lit(None).cast(t).alias(s) for s, t in types.items()], "n"
            )
        )
    if not parts:
        return df.sparkSession.createDataFrame([], "i int, whole long, fraction double, text string, n long")
    return reduce(DataFrame.unionByName, parts)


def present() -> Column:
    """True for the value rows of ``value_counts``, false for its null row."""
    return F.col("whole").isNotNull() | F.col("fraction").isNotNull() | F.col("text").isNotNull()


def number() -> Column:
    return F.coalesce(F.col("whole").cast("double"), F.col("fraction"))


def finite_or_null(name: str) -> Column:
    return F.nanvl(as_double(name), F.lit(None).cast("double"))


def most_frequent(df: DataFrame, columns: Sequence[str]) -> list[dict]:
    """Per column: values, distinct values, the most frequent value (smallest on ties) and its rows.

    Long texts are counted by digest. Only for a column that has any are its texts looked up in a second
    scan, which keeps the smallest text among the most frequent digests; texts are never shuffled.
    """
    counted = value_counts(df, columns, fingerprints=True)
    is_digest = F.octet_length("text") > LONG_TEXT
    best = F.min(F.when(present(), F.struct((-F.col("n")).alias("n"), "whole", "fraction", "text")))
    rows = counted.groupBy("i").agg(
        F.sum(F.when(present(), F.col("n"))).alias("n_values"),
        F.count(F.when(present(), 1)).alias("unique"),
        best.alias("top"),
        F.coalesce(F.bool_or(is_digest), F.lit(False)).alias("long"),
    ).collect()
    found = [{"n_values": 0, "unique": 0, "top": None, "n": 0} for _ in columns]
    for r in rows:
        top = r["top"]
        if top is None:
            continue
        value = next(v for v in (top["text"], top["whole"], top["fraction"]) if v is not None)
        if r["long"]:
            value = _smallest_text(df, columns[r["i"]], counted.where(F.col("i") == r["i"]), -top["n"])
        found[r["i"]] = {"n_values": r["n_values"], "unique": r["unique"], "top": value, "n": -top["n"]}
    return found


def _smallest_text(df: DataFrame, column: str, counted: DataFrame, n: int) -> str:
    texts = df.select(col(column).cast("string").alias("t"))
    if n > 1:
        ties = counted.where(F.col("n") == n).select(F.col("text").alias("k"))
        few = ties.count() <= TIED_DIGESTS
        texts = texts.withColumn("k", fingerprint(F.col("t")))
        texts = texts.join(F.broadcast(ties) if few else ties, "k", "left_semi")
    return texts.agg(F.min("t")).first()[0]
