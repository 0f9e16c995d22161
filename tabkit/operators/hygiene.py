"""Column hygiene and cleaning: unwanted columns, missing values, outliers.

Statistics are gathered first, as one aggregate, and become literals; what is returned is then a plain
projection or filter of the input that Catalyst can fuse with the steps before and after it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.functions.kinds import (
    BOOLEAN, DATETIME, NESTED, NUMERIC, TEXT, as_double, col, is_integral, kinds, numeric_columns, text_columns,
)
from tabkit.functions.quantiles import quantiles
from tabkit.functions.rules import findings
from tabkit.functions.stats import finite_or_null, most_frequent
from tabkit.operators.profile import column_stats, histogram
from tabkit.session import shared_table

# Names that suggest an identifier, searched anywhere in the column name, case-insensitive. Fixed values.
ID_NAME_PATTERNS = (
    "id$", "_id$", "identifier", "code$", "number$", "ssn$", "passport", "employee", "customer", "client",
    "user", "account", "candidate", "student", "patient", "member", "record", "entry", "transaction",
    "order", "product", "item", "entity", "reference",
)

# Parts of a lower-case name that make the quick clean-up drop a column. Fixed values.
ID_NAME_PARTS = ("id", "candidate", "user", "customer", "employee")


def detect_unwanted(df: DataFrame, target: str | None = None, exact: bool = True) -> DataFrame:
    """(column_name, reason, value): one row per column and rule it breaks; the target is not judged.

    Sequences need no sort: ``n`` distinct values without nulls and equal fractional parts are consecutive
    exactly when ``max - min = n - 1``, and the mean step of sorted distinct values is ``(max - min) / (n - 1)``.
    """
    judged = df.select(*[col(c) for c in df.columns if c != target])
    n, unique = F.col("n"), F.col("unique_values")
    ratio = F.try_divide(unique.cast("double"), n)
    missing = F.try_divide(F.col("missing_values").cast("double"), n)
    integral = F.col("column_name").isin([f.name for f in df.schema.fields if is_integral(f.dataType)])
    numeric, text = F.col("kind") == NUMERIC, F.col("kind") == TEXT
    distinct = numeric & (n > 0) & (unique == n)
    span = F.col("span")
    consecutive = F.col("whole_steps") & (span == n - 1)
    pattern = "(?i)(" + "|".join(ID_NAME_PATTERNS) + ")"

    def reason(code: str, value: Column) -> dict[str, Column]:
        return {"reason": F.lit(code), "value": F.round(value.cast("double"), 6)}

    return findings(
        column_stats(judged, exact),
        [
            (F.col("column_name").rlike(pattern), reason("id_like_name", F.lit(1))),
            (ratio > 0.95, reason("uniqueness_gt_95", ratio)),
            ((ratio > 0.90) & (ratio <= 0.95), reason("uniqueness_gt_90", ratio)),
            (distinct & consecutive, reason("sequential", F.lit(1))),
            (
                distinct & ~consecutive & (F.try_divide(span, n - 1) < 100),
                reason("increasing_sequence", F.try_divide(span, n - 1)),
            ),
            (integral & (unique > 1000) & (ratio > 0.8), reason("high_cardinality_integer", unique)),
            (unique == 1, reason("constant", unique)),
            (text & (unique > 100), reason("high_cardinality_text", unique)),
            (missing > 0.7, reason("mostly_missing", missing)),
            (text & F.coalesce("date_like", F.lit(False)), reason("date_string", F.lit(1))),
        ],
        keep=["column_name"],
    )


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns; names that are not there are ignored."""
    return df.drop(*names)


def id_like_columns(df: DataFrame, target: str | None = None) -> list[str]:
    return [c for c in df.columns if c != target and any(part in c.lower() for part in ID_NAME_PARTS)]


def drop_id_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    return df.drop(*id_like_columns(df, target))


def _columns_with_nulls(df: DataFrame, columns: Sequence[str]) -> list[str]:
    if not columns:
        return []
    row = df.agg(*[F.bool_or(col(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[i]]


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest on ties; ``None`` without any value."""
    columns = list(columns)
    return {c: f["top"] for c, f in zip(columns, most_frequent(df, columns))} if columns else {}


def _mode_literal(df: DataFrame, name: str, value: object) -> Column:
    data_type, kind = df.schema[name].dataType, kinds(df)[name]
    if value is None:
        if kind == NUMERIC:
            return F.lit(0).cast(data_type)
        return F.lit("Unknown") if kind == TEXT else F.lit(None).cast(data_type)
    if kind == DATETIME:
        if data_type.simpleString() == "date":
            return F.date_from_unix_date(F.lit(int(value)))
        return F.timestamp_micros(F.lit(int(value)).cast("long")).cast(data_type)
    return F.lit(value).cast(data_type)


def fill_values(df: DataFrame, strategy: str, columns: Sequence[str], exact: bool = True) -> dict[str, Column]:
    """The value that replaces a missing one, per column the strategy applies to."""
    numeric = [c for c in columns if kinds(df)[c] == NUMERIC]
    if strategy == "mean":
        row = df.agg(*[F.avg(finite_or_null(c)).alias(f"m{i}") for i, c in enumerate(numeric)]).first() if numeric else []
        return {c: F.lit(row[i]).cast("double") for i, c in enumerate(numeric)}
    if strategy == "median":
        return {c: F.lit(v[0]).cast("double") for c, v in quantiles(df, numeric, [0.5], exact=exact).items()}
    if strategy == "mode":
        plain = [c for c in columns if kinds(df)[c] != NESTED]
        return {c: _mode_literal(df, c, v) for c, v in modes(df, plain).items()}
    raise ValueError(f"unknown strategy {strategy!r}")


def handle_missing(
    df: DataFrame, strategy: str, columns: Sequence[str] | None = None, exact: bool = True
) -> DataFrame:
    """mean / median (numeric columns), mode (any column) or drop (rows). Statistics come from the input."""
    columns = list(columns) if columns is not None else df.columns
    if strategy == "drop":
        return df.dropna(subset=list(columns))
    gaps = _columns_with_nulls(df, columns)
    values = fill_values(df, strategy, gaps, exact)
    return df.select(
        *[F.coalesce(col(c), values[c]).alias(c) if c in values else col(c) for c in df.columns]
    )


def impute_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return handle_missing(df, "mean", columns)


def impute_median(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    return handle_missing(df, "median", columns, exact)


def impute_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return handle_missing(df, "mode", columns)


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return handle_missing(df, "drop", columns)


def iqr_bounds(df: DataFrame, columns: Sequence[str], exact: bool = True) -> dict[str, tuple[float, float] | None]:
    """Fences ``Q1 - 1.5 IQR`` and ``Q3 + 1.5 IQR`` per column."""
    bounds: dict[str, tuple[float, float] | None] = {}
    for c, (q1, q3) in quantiles(df, columns, [0.25, 0.75], exact=exact).items():
        bounds[c] = None if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return bounds


def _outside(name: str, bounds: tuple[float, float] | None) -> Column:
    """True for an outlier; a missing value or a column without values is none."""
    if bounds is None:
        return F.lit(False)
    return F.coalesce((col(name) < F.lit(bounds[0])) | (col(name) > F.lit(bounds[1])), F.lit(False))


def iqr_outliers(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """The rows whose value lies outside the fences."""
    return df.where(_outside(column, iqr_bounds(df, [column], exact)[column]))


def zscore_outliers(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    """The rows more than ``limit`` population standard deviations from the mean."""
    x = finite_or_null(column)
    mean, std = df.agg(F.avg(x), F.stddev_pop(x)).first()
    if not std:
        return df.where(F.lit(False))
    return df.where(F.abs((as_double(column) - F.lit(mean)) / F.lit(std)) > F.lit(limit))


def outlier_counts(df: DataFrame, target: str | None = None, exact: bool = True) -> DataFrame:
    """Outliers per numeric column except the target."""
    columns = numeric_columns(df, target)
    bounds = iqr_bounds(df, columns, exact)
    items = [
        F.struct(F.lit(c).alias("column_name"), F.count_if(_outside(c, bounds[c])).alias("outliers")) for c in columns
    ]
    return df.agg(F.array(*items).alias("a")).select(F.inline("a"))


def remove_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None, sequential: bool = True,
    exact: bool = True,
) -> DataFrame:
    """Drop outlier rows. Sequential: the fences of each column come from the rows the earlier columns left.

    The columns are stored once without the others, and fences are found there; each round adds one literal filter,
    so the result is a single filter of the input.
    """
    columns = list(columns) if columns is not None else numeric_columns(df, target)
    columns = [c for c in columns if c != target]
    if not sequential:
        bounds = iqr_bounds(df, columns, exact)
        for c in columns:
            df = df.where(~_outside(c, bounds[c]))
        return df
    narrow = shared_table(df.select(*[col(c) for c in columns]), "outliers") if len(columns) > 1 else df
    for c in columns:
        bounds = iqr_bounds(narrow, [c], exact)[c]
        df, narrow = df.where(~_outside(c, bounds)), narrow.where(~_outside(c, bounds))
    return df


def cap_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None, exact: bool = True
) -> DataFrame:
    """Clip numeric columns to their fences; a column with outliers becomes double, others are unchanged."""
    columns = [c for c in (list(columns) if columns is not None else numeric_columns(df)) if c != target]
    bounds = iqr_bounds(df, columns, exact)
    hit = df.agg(*[F.bool_or(_outside(c, bounds[c])).alias(f"o{i}") for i, c in enumerate(columns)]).first()
    capped = {}
    for i, c in enumerate(columns):
        if hit[i]:
            low, high = bounds[c]
            clipped = F.least(F.greatest(as_double(c), F.lit(low)), F.lit(high))
            capped[c] = F.when(col(c).isNotNull(), clipped)
    return df.select(*[capped[c].alias(c) if c in capped else col(c) for c in df.columns])


def handle_outliers(
    df: DataFrame, method: str, columns: Sequence[str] | None = None, target: str | None = None, exact: bool = True
) -> tuple[DataFrame, int]:
    """Remove or cap, with the number of outliers handled."""
    columns = [c for c in (list(columns) if columns is not None else numeric_columns(df)) if c != target]
    if method == "remove":
        cleaned = remove_outliers(df, columns, target, exact=exact)
        return cleaned, df.count() - cleaned.count()
    if method == "cap":
        handled = outlier_counts(df.select(*[col(c) for c in columns]), exact=exact).agg(F.sum("outliers")).first()[0]
        return cap_outliers(df, columns, target, exact), int(handled or 0)
    raise ValueError(f"unknown method {method!r}")


def clean_all(df: DataFrame, order_key: Sequence[str], target: str | None = None, exact: bool = True) -> DataFrame:
    """Drop identifier columns, impute (median for numbers, mode otherwise), code texts by first appearance.

    ``order_key`` gives the row order that "first" refers to; it is read before identifiers are dropped.
    """
    from tabkit.operators.encode import factorize

    dropped = id_like_columns(df, target)
    kept = [c for c in df.columns if c not in dropped]
    gaps = _columns_with_nulls(df, kept)
    numeric = [c for c in gaps if kinds(df)[c] == NUMERIC]
    values = {
        **fill_values(df, "median", numeric, exact),
        **fill_values(df, "mode", [c for c in gaps if c not in numeric], exact),
    }
    filled = df.select(
        *[F.coalesce(col(c), values[c]).alias(c) if c in values else col(c) for c in df.columns]
    )
    coded = factorize(filled, [c for c in text_columns(filled, target) if c in kept], order_key)
    return coded.select(*[col(c) for c in kept])


def compare_distribution(before: DataFrame, after: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Two histograms, each over its own range, tagged by side."""
    sides = [histogram(t, column, bins).withColumn("side", F.lit(s)) for s, t in (("before", before), ("after", after))]
    return sides[0].unionByName(sides[1])


def frames_equal(a: DataFrame, b: DataFrame) -> bool:
    """Same schema and the same rows with the same number of copies; row order does not matter.

    Both sides are counted per row in one shuffle, copies before it, instead of two set differences.
    """
    if [(f.name, f.dataType) for f in a.schema.fields] != [(f.name, f.dataType) for f in b.schema.fields]:
        return False
    sides = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1)))
    unequal = sides.groupBy(*[col(c) for c in a.columns]).agg(F.sum("_s").alias("_s")).where("_s <> 0")
    return unequal.limit(1).isEmpty()


def name_matches(name: str) -> bool:
    """Whether a column name looks like an identifier."""
    return any(re.search(p, name, re.IGNORECASE) for p in ID_NAME_PATTERNS)
