"""Saved models: Spark ML folders and a Parquet table that lists them."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.plans.train import Trained

VERSION = "1.0"
REGISTRY_SCHEMA = (
    "id string, model_name string, problem_type string, target_column string, saved_at timestamp, "
    "version string, path string, classes array<string>, metrics map<string, double>, run_id string"
)


def save_model(spark: SparkSession, trained: Trained, registry: str) -> str:
    """Write the fitted pipeline and its entry; returns the id. The entry comes last, so it never lacks its model."""
    now = datetime.now(timezone.utc)
    model_id = f"{trained.name.lower().replace(' ', '_')}_{now.strftime('%Y%m%d_%H%M%S_%f')}"
    path = f"{registry}/models/{model_id}"
    trained.pipeline.write().save(path)
    row = (
        model_id, trained.name, trained.problem_type, trained.target, now, VERSION, path, trained.classes,
        {k: float(v) for k, v in trained.run["metrics"].items() if v is not None}, trained.run["run_id"],
    )
    spark.createDataFrame([row], REGISTRY_SCHEMA).coalesce(1).write.mode("append").parquet(f"{registry}/entries")
    return model_id


def list_models(spark: SparkSession, registry: str) -> DataFrame:
    """All entries, newest first; none in a registry without entries."""
    entries = spark._jvm.org.apache.hadoop.fs.Path(f"{registry}/entries")
    if not entries.getFileSystem(spark._jsc.hadoopConfiguration()).exists(entries):
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    return spark.read.schema(REGISTRY_SCHEMA).parquet(f"{registry}/entries").orderBy(F.desc("saved_at"), F.desc("id"))


def load_model(spark: SparkSession, registry: str, model_id: str) -> Trained:
    row = list_models(spark, registry).where(F.col("id") == model_id).first()
    if row is None:
        raise ValueError(f"no saved model {model_id!r}")
    run = {"run_id": row["run_id"], "model": row["model_name"], "metrics": row["metrics"]}
    return Trained(
        row["model_name"], row["problem_type"], row["target_column"], PipelineModel.load(row["path"]),
        row["classes"], run,
    )
