"""Scoring a stream. The scoring plan keeps no state, so no watermark is needed and every row is final."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabkit.functions.kinds import normalise_nulls
from tabkit.plans.score import score
from tabkit.plans.train import Trained


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """Files that appear in a folder; a stream needs its schema up front."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return normalise_nulls(reader.load(path))


def score_stream(trained: Trained, stream: DataFrame) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a streaming table; use score()")
    return score(trained, stream)


def write_scored(
    scored: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = False,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Append scored rows to a folder; with its checkpoint a restarted query neither repeats nor skips rows."""
    writer = scored.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start(path)
