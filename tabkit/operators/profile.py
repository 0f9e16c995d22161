"""Profiling and exploration: what is in a table."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.functions.kinds import (
    BOOLEAN, DATETIME, NESTED, NUMERIC, TEXT, as_double, col, columns_of, is_integral, kind_of, kinds, numeric_columns,
    require_columns, text_columns,
)
from tabkit.functions.quantiles import quantiles
from tabkit.functions.ranking import hash_cutoffs, row_hash
from tabkit.functions.rules import findings, percent
from tabkit.functions.stats import finite_or_null, most_frequent, number, present, value_counts
from tabkit.session import shared_table

NATIVE_CORRELATION_PAIRS = 16


def _missing(name: str) -> Column:
    return F.count(F.lit(1)) - F.count(col(name))


def _column_table(df: DataFrame) -> DataFrame:
    """(position, column_name, data_type, kind): one row per column, from the schema alone."""
    rows = [(i, f.name, f.dataType.simpleString(), kind_of(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string, kind string")


def table_overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and columns with missing values, in one aggregate."""
    misses = [_missing(c) for c in df.columns]
    counted = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[m.alias(f"m{i}") for i, m in enumerate(misses)],
    )
    parts = [F.col(f"m{i}") for i in range(len(misses))]
    return counted.select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        sum(parts, F.lit(0).cast("long")).alias("missing_cells"),
        sum([(p > 0).cast("int") for p in parts], F.lit(0)).alias("columns_with_missing"),
    )


def column_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column: counts, distinct values and the facts the hygiene rules need.

    Exact: from the value counts of all columns, every column read once. Otherwise one aggregate with
    HyperLogLog distinct counts and no shuffle of values.
    """
    if exact:
        counted = value_counts(df, fingerprints=True)
        fraction = F.pmod(F.col("fraction"), F.lit(1.0))
        date_like = F.col("text").rlike(r"^\d{4}-\d{2}-\d{2}")
        stats = counted.groupBy("i").agg(
            F.sum("n").alias("n"),
            F.sum(F.when(present(), F.col("n"))).alias("non_null"),
            F.count(F.when(present(), 1)).alias("unique"),
            F.min(number()).alias("low"),
            F.max(number()).alias("high"),
            F.coalesce(
                (F.max("whole").cast("decimal(38,0)") - F.min("whole").cast("decimal(38,0)")).cast("double"),
                F.max("fraction") - F.min("fraction"),
            ).alias("span"),
            (F.coalesce(F.max(fraction) - F.min(fraction), F.lit(0.0)) == 0).alias("whole_steps"),
            F.bool_and(date_like).alias("date_like"),
        )
    else:
        def unique(f):
            return F.approx_count_distinct(col(f.name)) if kind_of(f.dataType) != NESTED else F.lit(0).cast("long")

        def facts(f):
            numeric = kind_of(f.dataType) == NUMERIC
            value = as_double(f.name)
            exact_type = col(f.name).cast("decimal(38,0)") if is_integral(f.dataType) else value
            steps = F.pmod(value, F.lit(1.0))
            return F.struct(
                F.count(F.lit(1)).alias("n"),
                F.count(col(f.name)).alias("non_null"),
                unique(f).alias("unique"),
                (F.min(value) if numeric else F.lit(None).cast("double")).alias("low"),
                (F.max(value) if numeric else F.lit(None).cast("double")).alias("high"),
                ((F.max(exact_type) - F.min(exact_type)).cast("double") if numeric else F.lit(None).cast("double")).alias("span"),
                ((F.max(steps) == F.min(steps)) if numeric else F.lit(True)).alias("whole_steps"),
                (
                    F.bool_and(col(f.name).rlike(r"^\d{4}-\d{2}-\d{2}"))
                    if kind_of(f.dataType) == TEXT
                    else F.lit(None).cast("boolean")
                ).alias("date_like"),
            )

        stats = df.agg(F.array(*[facts(f) for f in df.schema.fields]).alias("a")).select(
            F.posexplode("a").alias("i", "f")
        ).select("i", "f.*")
    nested = F.col("kind") == NESTED
    return (
        _column_table(df)
        .join(F.broadcast(stats), F.col("position") == F.col("i"), "left")
        .select(
            "position",
            "column_name",
            "data_type",
            "kind",
            F.coalesce("n", F.lit(0)).alias("n"),
            F.coalesce("non_null", F.lit(0)).alias("non_null"),
            F.when(~nested, F.coalesce("unique", F.lit(0))).alias("unique_values"),
            (F.coalesce("n", F.lit(0)) - F.coalesce("non_null", F.lit(0))).alias("missing_values"),
            "low",
            "high",
            "span",
            "whole_steps",
            "date_like",
        )
    )


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: type, non-null count, distinct values (nulls not counted), missing values."""
    return column_stats(df, exact).select(
        "position", "column_name", "data_type", "non_null", "unique_values", "missing_values"
    )


def _comparable(field: T.StructField) -> Column:
    """A column as something that can be grouped: a map by its sorted entries, what holds maps as JSON, others as they are."""
    value, kind = col(field.name), field.dataType.simpleString()
    if isinstance(field.dataType, T.MapType) and "map<" not in kind[4:]:
        return F.array_sort(F.map_entries(value))
    return F.to_json(F.struct(value)) if "map<" in kind or "variant" in kind else value


#: Repeated hashes that are broadcast, eight bytes each.
BROADCAST_HASHES = 1_000_000


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows, binary and nested columns included; null equals null.

    Rows are first counted by a 64-bit hash, which moves eight bytes per row. Equal rows share a hash, so
    a table without repeated hashes has no duplicates and is done. Otherwise only rows with a repeated
    hash are compared in full.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.select(*[_comparable(f).alias(c) for f, c in zip(df.schema.fields, names)])
    absent = F.concat(*[F.when(col(c).isNull(), "0").otherwise("1") for c in names]) if names else F.lit("")
    hashed = rows.withColumn("_h", F.xxhash64(absent, *[col(c) for c in names]))
    repeated = shared_table(hashed.groupBy("_h").count().where("count > 1").select("_h"), "repeated-hashes")
    few = repeated.count()
    if few == 0:
        return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("duplicate_rows"))
    rows = hashed.join(F.broadcast(repeated) if few <= BROADCAST_HASHES else repeated, "_h", "left_semi").drop("_h")
    copies = rows.groupBy(*[col(c) for c in names]).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def dtype_distribution(df: DataFrame) -> DataFrame:
    """Type -> number of columns."""
    return _column_table(df).groupBy("data_type").agg(F.count(F.lit(1)).alias("n_columns"))


def missing_summary(df: DataFrame, digits: int = 2) -> DataFrame:
    """Columns with missing values: count and percentage of all rows."""
    n = F.count(F.lit(1))
    items = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column_name"),
            _missing(c).alias("missing_count"),
            percent(_missing(c), n, digits).alias("missing_percentage"),
        )
        for i, c in enumerate(df.columns)
    ]
    return df.agg(F.array(*items).alias("a")).select(F.inline("a")).where("missing_count > 0")


def missing_columns(df: DataFrame) -> DataFrame:
    """Names of the columns with at least one missing value."""
    return missing_summary(df).select("position", "column_name")


def numeric_describe(
    df: DataFrame, columns: Sequence[str] | None = None, digits: int = 2, exact: bool = True
) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear), max per numeric column."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    require_columns(df, columns)
    quartiles = quantiles(df, columns, [0.25, 0.5, 0.75], exact=exact)

    def fact(c: str, position: int) -> Column:
        x = finite_or_null(c)
        q = [F.lit(v).cast("double") for v in quartiles[c]]
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(c).alias("column_name"),
            F.count(x).alias("n_values"),
            F.round(F.avg(x), digits).alias("mean"),
            F.round(F.stddev_samp(x), digits).alias("std"),
            F.round(F.min(x), digits).alias("min"),
            F.round(q[0], digits).alias("q25"),
            F.round(q[1], digits).alias("q50"),
            F.round(q[2], digits).alias("q75"),
            F.round(F.max(x), digits).alias("max"),
        )

    if not columns:
        raise ValueError("the table has no numeric column")
    return df.agg(F.array(*[fact(c, i) for i, c in enumerate(columns)]).alias("a")).select(F.inline("a"))


def categorical_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per text column: distinct values, most frequent value (the smallest on ties) and its frequency."""
    columns = list(columns) if columns is not None else text_columns(df)
    text = df.select(*[col(c).cast("string").alias(c) for c in columns])
    rows = [
        (i, c, f["n_values"], f["unique"], f["top"], f["n"])
        for i, (c, f) in enumerate(zip(columns, most_frequent(text, columns)))
    ]
    schema = (
        "position int, column_name string, n_values long, unique_values long, most_frequent string, frequency long"
    )
    return df.sparkSession.createDataFrame(rows, schema)


def categorical_describe(df: DataFrame, column: str) -> DataFrame:
    """count, unique, top, freq of one text column."""
    return categorical_stats(df, [column]).select(
        "column_name", "n_values", "unique_values", "most_frequent", "frequency"
    )


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent non-null values; the smaller value first on ties."""
    return (
        df.where(col(column).isNotNull())
        .groupBy(col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(k)
    )


def histogram(df: DataFrame, columns: str | Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width bins over the non-null values of each column, empty bins included.

    The last bin is closed; a constant column gets a range of width one around its value. Infinities have no
    place on such bins and are left out.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    values = [finite_or_null(c) for c in columns]
    data = df.select(*[F.when(F.abs(v) < float("inf"), v).alias(f"c{i}") for i, v in enumerate(values)])
    ends = data.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in data.columns for f in (F.min, F.max)]).first()
    args, edges = [], []
    for i, name in enumerate(columns):
        low, high = ends[f"min_c{i}"], ends[f"max_c{i}"]
        if low is None:
            continue
        if low == high:
            low, high = low - 0.5, high + 0.5
        width = (high - low) / bins
        place = F.floor((F.col(f"c{i}") - F.lit(low)) / F.lit(width)).cast("int")
        args += [F.lit(i), F.when(place.isNotNull(), F.least(place, F.lit(bins - 1)))]
        edges.append((i, name, low, width))
    schema = "i int, column_name string, low double, width double"
    grid = df.sparkSession.createDataFrame(edges, schema).withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    )
    if args:
        counted = (
            data.select(F.stack(F.lit(len(edges)), *args).alias("i", "bin"))
            .where(F.col("bin").isNotNull())
            .groupBy("i", "bin")
            .agg(F.count(F.lit(1)).alias("n"))
        )
    else:
        counted = df.sparkSession.createDataFrame([], "i int, bin int, n long")
    return grid.join(F.broadcast(counted), ["i", "bin"], "left").select(
        "column_name",
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("bin_low"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _pair_rows(pairs: list[tuple[str, str, Column]]) -> Column:
    return F.array(
        *[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), r.alias("corr")) for a, b, r in pairs]
    )


def _correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(col_a, col_b, corr) for the given pairs: Pearson over the rows where both values are present."""
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    place = {c: i for i, c in enumerate(names)}
    data = df.select(*[finite_or_null(c).alias(f"c{i}") for c, i in place.items()])
    if len(pairs) > NATIVE_CORRELATION_PAIRS:
        return _blocked_correlations(data, names, pairs)
    counts = data.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in data.columns]).first()
    complete = {c: counts[f"c{i}"] == counts["n"] for c, i in place.items()}

    def corr(a: str, b: str) -> Column:
        x, y = F.col(f"c{place[a]}"), F.col(f"c{place[b]}")
        mx = x if complete[b] else F.when(y.isNotNull(), x)
        my = y if complete[a] else F.when(x.isNotNull(), y)
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(mx) * F.stddev_pop(my))

    return data.agg(_pair_rows([(a, b, corr(a, b)) for a, b in pairs]).alias("a")).select(F.inline("a"))


#: Tasks whose matrices are added up in one place before the sums meet.
GRAM_FAN = 32


def _packed_gram(total: np.ndarray) -> bytes:
    """Counts, sums, sums of squares and products (4, p, p) without what symmetry repeats."""
    upper = np.triu_indices(total.shape[1])
    return np.concatenate([total[0][upper], total[3][upper], total[1].ravel(), total[2].ravel()]).tobytes()


def _unpacked_gram(packed: bytes, p: int) -> np.ndarray:
    upper, flat = np.triu_indices(p), np.frombuffer(packed)
    total, half = np.zeros((4, p, p)), len(upper[0])
    for place, part in ((0, flat[:half]), (3, flat[half:2 * half])):
        total[place][upper] = part
        total[place] = np.triu(total[place]) + np.triu(total[place], 1).T
    total[1], total[2] = flat[2 * half:2 * half + p * p].reshape(p, p), flat[2 * half + p * p:].reshape(p, p)
    return total


def _blocked_correlations(data: DataFrame, names: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Many pairs: each task multiplies its rows into one small matrix of sums; one pass for all pairs.

    Hundreds of aggregates per row do not fit one compiled method; a matrix product per Arrow batch is several times
    faster and needs one scan for any number of columns. A task sends one row, its packed matrices, and these are
    added up in two levels.
    """
    summary = data.agg(
        *[f(c).alias(f"{f.__name__}_{c}") for c in data.columns for f in (F.avg, F.min, F.max)]
    ).first()
    centre = np.array([summary[f"avg_c{i}"] or 0.0 for i in range(len(names))])
    varies = np.array([summary[f"min_c{i}"] != summary[f"max_c{i}"] for i in range(len(names))])
    p, at = len(names), [(names.index(a), names.index(b)) for a, b in pairs]
    packed_type = pa.schema([("slot", pa.int32()), ("sums", pa.binary())])

    def sums(batches):
        total, slot = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            slot = batch.column("slot")[0].as_py()
            columns = [batch.column(f"c{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(p)]
            x = np.column_stack(columns)
            there = ~np.isnan(x)
            x = np.where(there, x - centre, 0.0)
            m = there.astype(float)
            part = np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"slot": [slot], "sums": [_packed_gram(total)]}, schema=packed_type)

    def added(parts: pa.Table) -> pa.Table:
        total = sum(_unpacked_gram(held, p) for held in parts.column("sums").to_pylist())
        return pa.Table.from_pydict({"slot": [0], "sums": [_packed_gram(total)]}, schema=packed_type)

    def correlated(parts: pa.Table) -> pa.Table:
        n, sx, sxx, sxy = sum(_unpacked_gram(held, p) for held in parts.column("sums").to_pylist())
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = (sxx - sx * sx / n) * (sxx - sx * sx / n).T
            r = (sxy - sx * sx.T / n) / np.sqrt(np.maximum(spread, 0))
        known = np.isfinite(r) & varies[:, None] & varies[None, :]
        rows = [{"col_a": a, "col_b": b, "corr": float(r[i, j]) if known[i, j] else None} for (a, b), (i, j) in zip(pairs, at, strict=True)]
        return pa.Table.from_pylist(rows, schema=pa.schema([("col_a", pa.string()), ("col_b", pa.string()), ("corr", pa.float64())]))

    kind = "slot int, sums binary"
    parts = data.withColumn("slot", F.spark_partition_id() % GRAM_FAN).mapInArrow(sums, kind)
    few = parts.groupBy("slot").applyInArrow(added, kind)
    found = few.groupBy("slot").applyInArrow(correlated, "col_a string, col_b string, corr double")
    if data.isEmpty():
        return data.sparkSession.createDataFrame([(a, b, None) for a, b in pairs], "col_a string, col_b string, corr double")
    return found


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All ordered pairs (col_a, col_b, corr); null where a column does not vary. Needs two columns."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    if len(columns) < 2:
        raise ValueError("a correlation matrix needs at least two numeric columns")
    half = _correlations(df, list(combinations_with_replacement(columns, 2)))
    mirrored = F.array(
        F.struct("col_a", "col_b", "corr"),
        F.when(
            F.col("col_a") != F.col("col_b"),
            F.struct(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "corr"),
        ),
    )
    return half.select(F.inline(F.array_compact(mirrored)))


def strong_pairs(df: DataFrame, threshold: float = 0.7, columns: Sequence[str] | None = None) -> DataFrame:
    """Pairs of different columns with |r| above the threshold, rounded to 3 digits."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    pairs = [(a, b) for a, b in combinations_with_replacement(columns, 2) if a != b]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    strong = _correlations(df, pairs).where(F.abs("corr") > threshold)
    return strong.withColumn("corr", F.round("corr", 3))


def target_correlations(df: DataFrame, target: str) -> DataFrame:
    """(column_name, corr, abs_corr) of every other numeric column with a numeric target."""
    if target not in numeric_columns(df):
        raise ValueError(f"target {target!r} is not a numeric column")
    pairs = [(c, target) for c in numeric_columns(df, target)]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_name string, corr double, abs_corr double")
    return _correlations(df, pairs).select(
        F.col("col_a").alias("column_name"), "corr", F.abs("corr").alias("abs_corr")
    )


def top_target_correlates(df: DataFrame, target: str, k: int = 5) -> DataFrame:
    found = target_correlations(df, target).where(F.col("abs_corr").isNotNull())
    return found.orderBy(F.desc("abs_corr"), "column_name").limit(k)


def weak_features(df: DataFrame, target: str, threshold: float = 0.1, k: int | None = 3) -> DataFrame:
    """Columns with |r| below the threshold, the strongest of them first."""
    weak = target_correlations(df, target).where(F.col("abs_corr") < threshold)
    weak = weak.orderBy(F.desc("abs_corr"), "column_name")
    return weak if k is None else weak.limit(k)


def high_cardinality(df: DataFrame, ratio: float = 0.5, exact: bool = True) -> DataFrame:
    """Text columns whose distinct values exceed the given share of all rows."""
    share = F.try_divide(F.col("unique_values").cast("double"), F.col("n"))
    stats = column_stats(df.select(*[col(c) for c in text_columns(df)]), exact)
    return stats.where(share > ratio).select("column_name", "unique_values", F.round(share, 4).alias("unique_ratio"))


def pair_sample(df: DataFrame, key: Sequence[str], n: int = 1000, max_cols: int = 5, seed: int = 42) -> DataFrame:
    """``n`` pseudo-random rows of the first numeric columns; the same rows for the same seed and keys.

    Of rows that share the last key in the sample, those with the smallest values fill it up.
    """
    columns = numeric_columns(df)[:max_cols]
    rows = df.count()
    hashed = df.select(*[col(c) for c in columns], row_hash(key, seed).alias("_h"))
    if rows > n:
        cut = hash_cutoffs(hashed.select(F.col("_h").alias("h")), [], lambda size: [F.lit(n)], rows).first()["t0"]
        hashed = hashed.where(F.col("_h") <= F.lit(cut)).orderBy("_h", *[col(c) for c in columns]).limit(n)
    return hashed.drop("_h")


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Text target: value, count and share of all rows. Numeric target: its description."""
    if kinds(df)[target] == NUMERIC:
        return numeric_describe(df, [target])
    n = df.count()
    return (
        df.where(col(target).isNotNull())
        .groupBy(col(target).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("percentage", percent(F.col("n"), F.lit(n)))
    )


def target_counts(df: DataFrame, target: str) -> DataFrame:
    """Distinct and missing values of the target."""
    stats = column_stats(df.select(col(target)))
    return stats.select("column_name", "unique_values", "missing_values")


def validate(df: DataFrame) -> DataFrame:
    """Readiness findings ``(severity, code, detail)``; only ``empty`` makes a table invalid."""
    n = F.col("n")
    counted = df.agg(F.count(F.lit(1)).alias("n"), *[_missing(c).alias(f"m{i}") for i, c in enumerate(df.columns)])
    missing = F.concat_ws(", ", *[F.when(F.col(f"m{i}") > 0, F.lit(c)) for i, c in enumerate(df.columns)])
    duplicates = duplicate_count(df).first()["duplicate_rows"]
    n_numeric, n_text, n_all = len(numeric_columns(df)), len(text_columns(df)), len(df.columns)
    filled = n > 0

    def note(severity: str, code: str, detail: Column | str = "") -> dict[str, Column | str]:
        return {"severity": severity, "code": code, "detail": detail}

    return findings(
        counted,
        [
            (n == 0, note("error", "empty")),
            (filled & (missing != ""), note("issue", "missing_values", missing)),
            (filled & F.lit(duplicates > 0), note("issue", "duplicate_rows", str(duplicates))),
            (filled & (n < 100), note("issue", "very_small", n.cast("string"))),
            (n > 100_000, note("recommendation", "large", n.cast("string"))),
            (filled & (F.lit(n_all) > n / 10), note("recommendation", "many_features", str(n_all))),
            (filled & F.lit(n_text > 0), note("recommendation", "encode_categorical", str(n_text))),
            (filled & F.lit(n_numeric < 2), note("issue", "few_numeric", str(n_numeric))),
        ],
    )


def insights(df: DataFrame, target: str | None = None) -> DataFrame:
    """Key facts about a table as codes with a value."""
    n_numeric, n_text = len(numeric_columns(df)), len(text_columns(df))
    cells = F.col("missing_cells") / F.nullif(F.col("n_rows") * F.col("n_columns"), F.lit(0)) * 100
    unique = None
    if target is not None and target in df.columns and kinds(df)[target] != NUMERIC:
        unique = column_stats(df.select(col(target))).first()["unique_values"]
    strong = strong_pairs(df).count() if n_numeric > 1 else 0

    def note(code: str, value: Column | float) -> dict[str, Column]:
        return {"code": F.lit(code), "value": (value if isinstance(value, Column) else F.lit(value)).cast("double")}

    is_target = target is not None and target in df.columns
    numeric_target = is_target and kinds(df)[target] == NUMERIC
    return findings(
        table_overview(df),
        [
            (F.col("n_rows") > 10_000, note("large_dataset", F.col("n_rows"))),
            (F.col("n_rows") < 1_000, note("small_dataset", F.col("n_rows"))),
            (cells > 20, note("high_missing", F.round(cells, 4))),
            ((cells > 0) & (cells <= 20), note("some_missing", F.round(cells, 4))),
            (F.lit(n_numeric > n_text), note("mostly_numeric", n_numeric)),
            (F.lit(n_numeric <= n_text), note("mostly_categorical", n_text)),
            (F.lit(is_target and not numeric_target and unique == 2), note("binary_target", 2)),
            (F.lit(is_target and not numeric_target and unique != 2), note("multiclass_target", unique or 0)),
            (F.lit(numeric_target), note("regression_target", 1)),
            (F.lit(strong > 0), note("strong_correlations", strong)),
        ],
    )
