"""Global order without a global window: hash cut-offs, dense positions and running totals.

A window without ``partitionBy`` pulls all rows into one task. The helpers here reach the same exact
answers from bucket counts, and use such a window only on tables whose size was checked.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabkit.functions.kinds import col
from tabkit.session import cut_lineage

ONE_TASK_ROWS = 1_000_000
BROADCAST_ROWS = 200_000
ROWS_PER_BUCKET = 200_000
MAX_PREFIX_DIGITS = 5


def row_hash(keys: Sequence[str], seed: int) -> Column:
    """A seeded pseudo-random order over rows: 32 hex digits from the row key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def fetched(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame | None:
    """A table of short rows as plain local rows, or ``None`` when it has more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    return None if len(rows) > limit else df.sparkSession.createDataFrame(rows, df.schema)


def settled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A per-group table ready to be joined.

    Fetched once and broadcast as plain rows when it is small, so that later uses do not compute it again;
    a larger one stays distributed and Spark chooses the join.
    """
    local = fetched(df, limit)
    return df if local is None else F.broadcast(local)


def hash_cutoffs(
    hashed: DataFrame,
    groups: Sequence[str],
    cuts: Callable[[Column], list[Column]],
    rows: int,
) -> DataFrame:
    """Per group, the hash at each wanted rank: one row per group with ``t0, t1, ...``.

    ``hashed`` has the group columns and ``h``. ``cuts`` turns the group size into ranks: ``t_j`` is the
    largest hash among the ``rank_j`` smallest of the group (null for rank 0). Rows are counted per hash
    prefix first, so only the rows of the prefix that holds a rank are ever ordered, and a group with a
    third of all rows is spread over all its prefixes.
    """
    digits = min(MAX_PREFIX_DIGITS, max(1, math.ceil(math.log(max(1.0, rows / ROWS_PER_BUCKET), 16))))
    prefixed = hashed.withColumn("p", F.substring("h", 1, digits))
    by_prefix = prefixed.groupBy(*groups, "p").agg(F.count(F.lit(1)).alias("cnt"))
    in_group = Window.partitionBy(*groups)
    upto = in_group.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    located = (
        by_prefix.withColumn("upto", F.sum("cnt").over(upto))
        .withColumn("size", F.sum("cnt").over(in_group))
        .withColumn("ranks", F.array(*[c.cast("long") for c in cuts(F.col("size"))]))
        .select(*groups, "p", "cnt", "upto", F.posexplode("ranks").alias("cut", "rank"))
        .where((F.col("rank") > F.col("upto") - F.col("cnt")) & (F.col("rank") <= F.col("upto")))
        .select(
            *[F.col(g).alias(f"_{g}") for g in groups],
            F.col("p").alias("_p"),
            "cut",
            (F.col("rank") - F.col("upto") + F.col("cnt")).alias("nth"),
        )
    )
    same = F.col("p") == F.col("_p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    nth = Window.partitionBy(*groups, "p", "cut").orderBy("h")
    n_cuts = len(cuts(F.lit(1)))
    return (
        prefixed.join(settled(located), same)
        .withColumn("rn", F.row_number().over(nth))
        .where(F.col("rn") == F.col("nth"))
        .groupBy(*groups)
        .agg(*[F.max(F.when(F.col("cut") == j, F.col("h"))).alias(f"t{j}") for j in range(n_cuts)])
    )


def attach(df: DataFrame, table: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join per-group constants; null groups match null."""
    right = table.select(*[F.col(g).alias(f"_{g}") for g in groups], *columns)
    condition = F.lit(True)
    for g in groups:
        condition = condition & col(g).eqNullSafe(F.col(f"_{g}"))
    return df.join(settled(right), condition, "left").drop(*[f"_{g}" for g in groups])


def _ranged(df: DataFrame, order: Sequence[Column], rows: int, slice_rows: int) -> DataFrame:
    """The rows in stored slices that follow one another in ``order``; ``_slice`` is the place of a row's slice. There are
    as many slices as the size of the table asks for, and the whole order decides where they are cut."""
    slices = max(2, -(-rows // max(slice_rows, 1)) * 2)
    ranged = df.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id())
    return cut_lineage(ranged)


def _starts(sliced: DataFrame, groups: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Per group and slice what the slices before it add up to: one small row each, joined by the place of the slice."""
    totals = sliced.groupBy(*groups, "_slice").agg(*[total.alias(name) for name, total in sums.items()])
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*groups, "_slice", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in sums])


def with_position(df: DataFrame, order: Sequence[str], name: str, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Add the 0-based position of each row in the order of ``order`` (unique rows expected)."""
    n, by = df.count(), [col(o) for o in order]
    if n <= one_task_rows:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*by)).cast("long") - 1)
    sliced = _ranged(df, by, n, one_task_rows)
    placed = attach(sliced, _starts(sliced, [], {"_start": F.count(F.lit(1))}), ["_slice"], ["_start"])
    place = F.row_number().over(Window.partitionBy("_slice").orderBy(*by))
    return placed.withColumn(name, F.col("_start") + place.cast("long") - 1).drop("_start", "_slice")


def running_totals(
    df: DataFrame,
    key: str,
    sums: dict[str, str],
    previous: dict[str, str] | None = None,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Running sums in descending order of the numeric, unique ``key``.

    ``sums`` maps a column to the name of its running sum (including the row); ``previous`` maps a column
    to the name of the running sum before the row. A large table is cut into slices of the order: totals per slice
    give each slice its start, and the windows run inside the slices.
    """
    n = df.count()
    wanted = sorted(set(sums) | set(previous or {}))
    starts = {c: F.lit(0) for c in wanted}
    if n <= one_task_rows:
        out, window = df, Window.orderBy(F.desc(key))
    else:
        sliced = _ranged(df, [F.desc(key)], n, one_task_rows)
        table = _starts(sliced, [], {f"_before_{c}": F.sum(c) for c in wanted})
        out = attach(sliced, table, ["_slice"], [f"_before_{c}" for c in wanted])
        starts = {c: F.col(f"_before_{c}") for c in wanted}
        window = Window.partitionBy("_slice").orderBy(F.desc(key))
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    for c, name in sums.items():
        out = out.withColumn(name, starts[c] + F.sum(c).over(upto))
    for c, name in (previous or {}).items():
        out = out.withColumn(name, starts[c] + F.coalesce(F.sum(c).over(before), F.lit(0)))
    return out.drop("_slice", *[f"_before_{c}" for c in wanted])


def rank_within(
    df: DataFrame,
    groups: Sequence[str],
    score: str,
    tie: Sequence[str],
    name: str,
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """1-based rank of each row in its group by descending score.

    A large table is cut into slices of the whole order, ties included, so neither a group with a third of all rows
    nor a million equal scores end in one task: counts per group and slice give each slice its first rank.
    """
    n = df.count()
    order = [F.col(score).desc_nulls_last(), *[F.col(t) for t in tie]]
    if n <= one_task_rows:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    sliced = _ranged(df, [*[F.col(g) for g in groups], *order], n, one_task_rows)
    placed = attach(sliced, _starts(sliced, list(groups), {"_start": F.count(F.lit(1))}), [*groups, "_slice"], ["_start"])
    place = F.row_number().over(Window.partitionBy(*groups, "_slice").orderBy(*order))
    return placed.withColumn(name, (F.col("_start") + place).cast("int")).drop("_start", "_slice")
