"""Rule tables: conditions over a row become rows of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def findings(df: DataFrame, rules: Sequence[tuple[Column, dict[str, Column | str]]], keep: Sequence[str] = ()) -> DataFrame:
    """One output row per row of ``df`` and rule whose condition holds."""
    items = [
        F.when(
            condition,
            F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]),
        )
        for condition, fields in rules
    ]
    return df.select(*keep, F.inline(F.array_compact(F.array(*items))))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(F.lit(100.0) * part, whole), digits)
