"""Token-count rollups kept up to date by signed deltas in idempotent batch commits.

A rollup is a folder. A batch of changes is reduced to signed sums by source, language and tokenizer version, written
to a folder of its own below ``data``; the commit is a small file ``commits/<id>`` that names this folder. What counts
is what such a file names, and it names one folder, so a batch counts once however often or by how many writers at a
time it is sent, and what a writer left behind before its commit counts for nothing. No rename is needed, so an object
store serves as well as a file system. Totals read all folders in force by one scan; a compaction writes their sum as
one batch and names the batches that it stands for, which are then left out.

Changes: ``insert`` adds a document with its count, ``delete`` takes it away, ``revise`` replaces the old count by
the new one. Sums are pre-aggregated in each task, so a source with most documents costs no more than others.

Defined cases: null group columns are a group of their own; a null count is zero; a null or unknown change fails
the batch before anything is committed. Repeated rows are changes of their own. A batch without rows commits
and adds nothing. Groups whose documents are all gone are left out of the totals. Further columns are ignored.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUPS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, replaces string, batch string"


class Rollup:
    """Totals by source, language and tokenizer version in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _commits(self) -> dict[str, str]:
        """Committed batches with the folders that hold them; a file without a name is no commit."""
        files = self._files()
        if not files.exists(self._path("commits")):
            return {}
        names = [s.getPath().getName() for s in files.listStatus(self._path("commits"))]
        found = {name: self._named(name) for name in names if not name.startswith(("_", "."))}
        return {name: folder for name, folder in sorted(found.items()) if folder}

    def _named(self, batch: str) -> str:
        stream = self._files().open(self._path(f"commits/{batch}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def committed(self) -> list[str]:
        """The ids of committed batches, compactions among them."""
        return list(self._commits())

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commit (change, source, lang, tokenizer, old_tokens, new_tokens); False if the batch is committed already."""
        if batch in self._commits():
            return False
        old, new = F.coalesce("old_tokens", F.lit(0)), F.coalesce("new_tokens", F.lit(0))
        unknown = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("change", F.lit("null"))))
        kind = F.col("change")
        docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(unknown.cast("int"))
        counts = F.when(kind == "insert", new).when(kind == "delete", -old).when(kind == "revise", new - old).otherwise(unknown.cast("long"))
        signed = changes.select(*GROUPS, docs.cast("long").alias("docs"), counts.cast("long").alias("tokens"))
        sums = signed.groupBy(*GROUPS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return self._write(batch, sums.withColumn("replaces", F.lit(None).cast("string")))

    def _write(self, batch: str, sums: DataFrame) -> bool:
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"a batch id has letters, digits, '_', '.' and '-' only: {batch!r}")
        folder = f"data/{uuid.uuid4().hex}"
        sums.withColumn("batch", F.lit(batch)).write.parquet(f"{self.folder}/{folder}")
        return self._mark(batch, folder)

    def _mark(self, batch: str, folder: str) -> bool:
        """Name the folder of a batch, unless another writer has named its own."""
        files, path = self._files(), self._path(f"commits/{batch}")
        if files.exists(path) and self._named(batch):
            return False
        # where two writers come this far, the later name stands: either folder holds the whole batch
        stream = files.create(path, True)
        stream.writeBytes(folder)
        stream.close()
        return self._named(batch) == folder

    def _batches(self) -> DataFrame:
        """The rows of all batches in force; ``batch`` is the id."""
        folders = self._commits().values()
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/{folder}" for folder in folders])
        replaced = {name for row in rows.filter("replaces IS NOT NULL").select("replaces").distinct().collect() for name in row[0].split(",")}
        return rows.filter(~F.col("batch").isin(sorted(replaced))) if replaced else rows

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all batches in force."""
        rows = self._batches().groupBy(*GROUPS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return rows.filter("docs != 0 OR tokens != 0")

    def compact(self) -> bool:
        """Commit the totals so far as one batch in place of those they sum up. Done twice, it adds nothing."""
        names = self.committed()
        if len(names) < 2:
            return False
        replaces = F.lit(",".join(names))
        totals = self._batches().groupBy(*GROUPS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return self._write(f"compact-{len(names)}-{uuid.uuid5(uuid.NAMESPACE_OID, ','.join(names)).hex}", totals.withColumn("replaces", replaces))
