"""The corpus pipeline: five operators in a row, each on what its predecessor kept, with Parquet in between."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.llm import bpe, decontaminate, lines, queries, simhash
from tabkit.llm.common import removed, shared_folder, stored, table, temporaries

#: The classifier and the SimHash have no equivalent in SQL.
ORACLE_SQL = None

#: Repeated ids that are broadcast.
BROADCAST_IDS = 100_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good and not toxic."""
    return queries._judged(spark, docs, sf_dir, COLUMNS).filter("keep").select(*COLUMNS)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that a document with a smaller id holds; a null text stays null."""
    kept = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))
    size = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", size.alias("n_chars"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the smallest by id (rows without an id last), fingerprint and hash of the
    columns. Rows of one id with different texts are told apart by their fingerprints."""
    found = stored(simhash.near_duplicates(docs), "near-duplicates")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp")).alias("s")
    first = found.groupBy("low").agg(smallest).select("s.doc_id", "s.fp")
    sizes = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    repeated = stored(sizes.filter("n > 1").select("doc_id"), "repeated-ids")
    if repeated.count() <= BROADCAST_IDS:
        repeated = F.broadcast(repeated)
    single = first.filter("doc_id IS NOT NULL").join(repeated, "doc_id", "left_anti")
    kept = docs.join(single, "doc_id", "left_semi").select(*COLUMNS)
    unclear = docs.filter("doc_id IS NULL").select(*COLUMNS).union(docs.join(repeated, "doc_id", "left_semi").select(*COLUMNS))
    prints = unclear.withColumn("__fp", simhash.fingerprint_of(F.col("text")))
    least = F.min(F.struct(F.xxhash64(*COLUMNS).alias("h"), *COLUMNS)).alias("s")
    rows = prints.groupBy(F.col("doc_id").alias("__id"), "__fp").agg(least)
    chosen = rows.join(first, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__fp") == F.col("fp")), "left_semi")
    return kept.union(chosen.select("s.*").select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    found = decontaminate.annotate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter("NOT contaminated").select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digest of what they decode to and whether that is the text."""
    narrow = docs.select("doc_id", "lang", "source", "text")
    decoded = bpe.encode(narrow, "text", queries._tokenizer(), public_tokenizers.PATTERN, bytes_col="decoded")
    round_trip = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return decoded.select("doc_id", "lang", "source", *queries._digests(), round_trip.alias("round_trip"), "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", lines_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again before the next stage. What a stage stored on
    its way is removed when its result is written, as is the result of its predecessor."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_folder(spark, name.replace(" ", "-"))
        with temporaries(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
