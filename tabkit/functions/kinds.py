"""Column kinds: every operator decides what to do with a column from its kind."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
TEXT = "text"
BOOLEAN = "boolean"
DATETIME = "datetime"
NESTED = "nested"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, _INTEGRAL + _FLOATING + (T.DecimalType,)):
        return NUMERIC
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return NESTED


def is_integral(data_type: T.DataType) -> bool:
    return isinstance(data_type, _INTEGRAL)


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, _FLOATING)


def col(name: str) -> Column:
    """A column by its exact name, also when the name has dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, *wanted: str, exclude: Iterable[str | None] = ()) -> list[str]:
    skipped = {name for name in exclude if name}
    return [name for name, kind in kinds(df).items() if kind in wanted and name not in skipped]


def numeric_columns(df: DataFrame, *exclude: str | None) -> list[str]:
    return columns_of(df, NUMERIC, exclude=exclude)


def text_columns(df: DataFrame, *exclude: str | None) -> list[str]:
    return columns_of(df, TEXT, exclude=exclude)


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {', '.join(missing)}")


def normalise_nulls(df: DataFrame) -> DataFrame:
    """One missing marker: NaN in float and double columns becomes NULL."""
    floating = {f.name: f.dataType for f in df.schema.fields if is_floating(f.dataType)}
    if not floating:
        return df
    return df.select(
        *[
            F.nanvl(col(c), F.lit(None).cast(floating[c])).alias(c) if c in floating else col(c)
            for c in df.columns
        ]
    )


def as_double(name: str) -> Column:
    return col(name).cast("double")
