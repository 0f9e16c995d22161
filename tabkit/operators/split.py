"""Preparation of a training table, train/test split and folds.

Rows are ordered by a seeded hash of their key, so membership does not depend on partitions or on the run.
The exact variants compute one hash threshold per class and part; assigning rows is then a comparison, and
the table itself is neither sorted nor shuffled. Keys should be unique: rows with the same key always end up
on the same side, so repeated keys make the sizes approximate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.functions.kinds import NUMERIC, TEXT, col, columns_of, kinds, require_columns
from tabkit.functions.ranking import attach, hash_cutoffs, row_hash
from tabkit.functions.stats import adjusted_skewness, finite_or_null

HASH_BITS = 60


def with_target(df: DataFrame, target: str) -> DataFrame:
    """The rows that have a target value."""
    require_columns(df, [target])
    return df.where(col(target).isNotNull())


def feature_kinds(df: DataFrame, target: str) -> tuple[list[str], list[str]]:
    """Numeric and text feature columns."""
    return columns_of(df, NUMERIC, exclude=[target]), columns_of(df, TEXT, exclude=[target])


def preparation_report(df: DataFrame, target: str) -> DataFrame:
    """One row on the rows that will be used: size, missing share, kind and range of the target."""
    rows = with_target(df, target)
    features = [c for c in df.columns if c != target]
    numeric, text = feature_kinds(df, target)
    is_numeric = kinds(df)[target] == NUMERIC
    nulls = sum((F.count(F.lit(1)) - F.count(col(c)) for c in features), F.lit(0))
    x = finite_or_null(target) if is_numeric else F.lit(None).cast("double")
    n = F.count(F.lit(1))
    facts = rows.agg(
        n.alias("n_samples"),
        F.lit(len(features)).alias("n_features"),
        F.round(F.try_divide(F.lit(100.0) * nulls, n * max(1, len(features))), 6).alias("missing_percentage"),
        F.lit("Numerical" if is_numeric else "Categorical").alias("target_type"),
        F.round(F.min(x), 6).alias("target_min"),
        F.round(F.max(x), 6).alias("target_max"),
        F.round(adjusted_skewness(x), 6).alias("target_skewness"),
        (F.abs(adjusted_skewness(x)) > 1).alias("target_skewed"),
        F.lit(len(numeric)).alias("n_numeric_features"),
        F.lit(len(text)).alias("n_categorical_features"),
    )
    if is_numeric:
        return facts.withColumn("target_classes", F.lit(None).cast("long"))
    classes = rows.select(col(target)).distinct().count()
    return facts.withColumn("target_classes", F.lit(classes).cast("long"))


def _hashed(df: DataFrame, key: Sequence[str], seed: int, label: str | None) -> tuple[DataFrame, list[str]]:
    require_columns(df, key)
    groups = ["_g"] if label else []
    out = df.withColumn("h", row_hash(key, seed))
    return (out.withColumn("_g", col(label)) if label else out), groups


def _with_cutoffs(df: DataFrame, groups: list[str], cuts, n_cuts: int) -> DataFrame:
    table = hash_cutoffs(df.select(*groups, "h"), groups, cuts, df.count())
    names = [f"t{j}" for j in range(n_cuts)]
    if groups:
        return attach(df, table, groups, names)
    row = table.first()
    return df.withColumns({t: F.lit(row[t] if row else None).cast("string") for t in names})


def assign_split(
    df: DataFrame, key: str | Sequence[str], test_frac: float = 0.2, seed: int = 42, stratify: str | None = None,
    method: str = "exact", name: str = "is_test",
) -> DataFrame:
    """Mark ``round(test_frac * size)`` rows of every class (or of the table) as test rows.

    ``method="hash"`` needs no pass over the table; the shares then hold only approximately.
    """
    if not 0 < test_frac < 1:
        raise ValueError("test_frac must lie between 0 and 1")
    key = [key] if isinstance(key, str) else list(key)
    if method == "hash":
        share = F.conv(F.substring(row_hash(key, seed), 1, HASH_BITS // 4), 16, 10).cast("long")
        return df.withColumn(name, share < F.lit(int(test_frac * (1 << HASH_BITS))))
    hashed, groups = _hashed(df, key, seed, stratify)
    marked = _with_cutoffs(hashed, groups, lambda n: [F.round(n * F.lit(test_frac))], 1)
    return marked.withColumn(name, F.coalesce(F.col("h") <= F.col("t0"), F.lit(False))).drop("h", "t0", *groups)


def split(
    df: DataFrame, key: str | Sequence[str], test_frac: float = 0.2, seed: int = 42, stratify: str | None = None,
    method: str = "exact",
) -> tuple[DataFrame, DataFrame]:
    """(train, test): disjoint, complete, and the same for the same seed and keys."""
    marked = assign_split(df, key, test_frac, seed, stratify, method, "_test")
    return marked.where(~F.col("_test")).drop("_test"), marked.where(F.col("_test")).drop("_test")


def assign_folds(
    df: DataFrame, key: str | Sequence[str], k: int = 5, seed: int = 42, stratify: str | None = None,
    name: str = "fold",
) -> DataFrame:
    """Fold numbers 0..k-1; the folds of a class differ by at most one row."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    key = [key] if isinstance(key, str) else list(key)
    hashed, groups = _hashed(df, key, seed, stratify)

    def cuts(n: Column) -> list[Column]:
        return [F.floor(n / k) * j + F.least(F.lit(j), n % k) for j in range(1, k)]

    marked = _with_cutoffs(hashed, groups, cuts, k - 1)
    above = sum((F.coalesce(F.col("h") > F.col(f"t{j}"), F.lit(True)).cast("int") for j in range(k - 1)), F.lit(0))
    return marked.withColumn(name, above).drop("h", *[f"t{j}" for j in range(k - 1)], *groups)
