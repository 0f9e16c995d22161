"""What several operators share: tables, the shared folder, batches for Python tasks, byte classes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabkit.session import ensure_checkpoint_dir

#: Characters of text that a Python task turns into words at a time.
SLICE_CHARS = 1_000_000

#: Copies of a small table's rows, over which a hot key of the other table is spread.
SALTS = 16

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made inside each ``temporaries`` block that is open.
_made: list[list[str]] = []


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below the checkpoint folder, which the driver and every executor can reach."""
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Remove the folders made inside, once what was computed from them is stored elsewhere."""
    _made.append([])
    try:
        yield
    finally:
        for name in _made.pop():
            removed(spark, name)


def removed(spark: SparkSession, name: str) -> None:
    """Delete a folder that ``shared_folder`` named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: a lost executor loses none of it."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def met(left: DataFrame, right: DataFrame, keys: list[str], how: str, broadcast_rows: int, weight: Column | None = None) -> DataFrame:
    """``left`` joined with a stored table of one row per key, nulls being equal: broadcast while small, else each of
    its rows under every salt, so that a key which many rows of ``left`` bear is spread over tasks. ``weight`` counts
    a row of varying size as several."""
    named = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    rows = right.count() if weight is None else right.agg(F.sum(weight)).first()[0] or 0
    if rows <= broadcast_rows:
        joined = left.join(F.broadcast(named), same, how)
    else:
        salts = F.explode(F.array(*[F.lit(s).cast("long") for s in range(SALTS)]))
        salted = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        other = named.withColumn("__other", salts)
        # without the hint Spark may broadcast every row under all its salts: it goes by the size of the stored files
        joined = salted.join(other.hint("merge"), [*same, F.col("__salt") == F.col("__other")], how)
    return joined.drop("__salt", "__other", *[f"__{k}" for k in keys])


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. ``lower`` does that alone where a text is ASCII only."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def extended(df: DataFrame, added: list[T.StructField]) -> T.StructType:
    return T.StructType([*df.schema.fields, *added])


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut a batch into runs of rows whose texts together stay near ``limit`` bytes; each with its texts."""
    sizes = pc.binary_length(batch.column(text)).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        held += size or 0
        if held >= limit or at + 1 == len(sizes):
            part = batch.slice(start, at + 1 - start)
            yield part, part.column(text).to_pylist()
            start, held = at + 1, 0


def appended(part: pa.RecordBatch, columns: list, schema: pa.Schema) -> pa.RecordBatch:
    """The batch with further columns, in the types of ``schema``."""
    arrays = list(part.columns)
    for field, values in zip(list(schema)[len(arrays):], columns, strict=True):
        arrays.append(values if isinstance(values, pa.Array) else pa.array(values, type=field.type))
    arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
