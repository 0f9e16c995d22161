"""Line deduplication across documents by range-partitioned hashes and per-document keep bitmaps.

Every line has a key: the line without ASCII white space at both ends, A-Z in lower case. Keys of ``min_chars``
code points or more that stand in several documents stay in the document with the smallest id only. Such keys
travel as 128-bit hashes with document and positions, one row per key and document; rows are range-partitioned
by hash and document, so a key that a third of all documents hold is spread over many tasks, and sorted. Each
task streams its rows and lets the first document of a hash pass. The first document in a task is settled by
the edges of all tasks: one row for its first and one for its last hash, a table as long as there are tasks.
The outcome is a bitmap per document with dropped lines, compressed; texts do not take part in it.

Defined cases: a null text is one empty line, as is an empty one; lines below ``min_chars`` always stay. Rows
that repeat a document id are one holder of a key, and each has a bitmap of its own lines. Rows without an id
keep all lines and make no other row lose one. Further columns are passed on by ``apply_bitmaps``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.llm.common import ASCII_SPACE, appended, arrow_schema, extended, slices, stored, without

MIN_CHARS = 10
_SPACE = ASCII_SPACE.encode()
_HASHED = "doc long, version long, n_lines int, hash binary, places array<int>"
_STREAMED = "doc long, version long, n_lines int, hash binary, places array<int>, task int, edge boolean"


def line_hashes(text: str | None, min_chars: int) -> tuple[int, dict[bytes, list[int]]]:
    """The number of lines, and the positions of each key that is long enough."""
    lines = (text or "").encode().split(b"\n")
    places: dict[bytes, list[int]] = {}
    for at, line in enumerate(lines):
        key = line.strip(_SPACE).lower()
        if len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode()) >= min_chars:
            places.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
    return len(lines), places


def _rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per document and key. ``version`` tells apart different texts under one id."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    types = arrow_schema(T._parse_datatype_string(_HASHED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                docs, versions, counts, hashes, places = [], [], [], [], []
                ids, marks = part.column("doc").to_pylist(), part.column("version").to_pylist()
                for doc, version, text in zip(ids, marks, texts, strict=True):
                    n, found = line_hashes(text, min_chars)
                    docs += [doc] * len(found)
                    versions += [version] * len(found)
                    counts += [n] * len(found)
                    hashes += found.keys()
                    places += found.values()
                columns = [docs, versions, counts, hashes, places]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    return narrow.filter("doc IS NOT NULL AND text IS NOT NULL").mapInArrow(run, _HASHED)


def _stream(batches: Iterator[pa.RecordBatch], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in the order of hash and document: later documents of a hash are let through as drops. The first
    document of the first hash is passed on as undecided, and with the last hash as an edge."""
    names = [f.name for f in types][:5]
    current, owner, first_hash, last = None, None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column("task")[0].as_py()
        hashes, docs = batch.column("hash").to_pylist(), batch.column("doc").to_pylist()
        taken, edges = [], []
        for at, (digest, doc) in enumerate(zip(hashes, docs, strict=True)):
            if digest != current:
                current, owner = digest, doc
                first_hash = first_hash or digest
            if doc != owner:
                taken.append(at)
                edges.append(False)
            elif digest == first_hash:
                taken.append(at)
                edges.append(True)
        last = (current, owner, task)
        part = batch.select(names).take(pa.array(taken, pa.int64()))
        yield appended(part, [pa.array([task] * len(taken), pa.int32()), edges], types)
    if last and last[0] != first_hash:
        row = {"doc": last[1], "version": None, "n_lines": 0, "hash": last[0], "places": [], "task": last[2], "edge": True}
        yield pa.RecordBatch.from_pylist([row], schema=types)


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, version, n_lines, n_dropped, keep) per document with dropped lines; ``keep`` is a compressed bitmap
    of its lines, first line in the highest bit. Documents that lose nothing have no row."""
    ranged = _rows(docs, id_col, text_col, min_chars).repartitionByRange("hash", "doc", "version")
    ranged = ranged.withColumn("task", F.spark_partition_id()).sortWithinPartitions("hash", "doc", "version")
    streamed_types = arrow_schema(T._parse_datatype_string(_STREAMED))
    streamed = stored(ranged.mapInArrow(lambda batches: _stream(batches, streamed_types), _STREAMED), "line-drops")
    edges = streamed.filter("edge")
    owners = edges.groupBy(F.col("hash").alias("edge_hash")).agg(F.min("doc").alias("owner"))
    late = edges.join(F.broadcast(owners), (F.col("hash") == F.col("edge_hash")) & (F.col("doc") > F.col("owner")), "left_semi")
    drops = streamed.filter("NOT edge").union(late).filter("version IS NOT NULL").select("doc", "version", "n_lines", "places")
    # rows that repeat one document bring the same places again
    places = F.array_distinct(F.flatten(F.collect_set("places")))
    grouped = drops.groupBy("doc", "version").agg(F.max("n_lines").alias("n_lines"), places.alias("places"))
    schema = "doc long, version long, n_lines long, n_dropped long, keep binary"
    types = arrow_schema(T._parse_datatype_string(schema))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, dropped = batch.column("n_lines").to_pylist(), batch.column("places").to_pylist()
            keep = []
            for size, gone in zip(sizes, dropped, strict=True):
                bits = np.ones(size, np.uint8)
                bits[gone] = 0
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
            head = batch.select(["doc", "version"])
            yield appended(head, [sizes, [len(gone) for gone in dropped], keep], types)

    return grouped.mapInArrow(pack, schema)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with ``n_lines``, ``n_dropped`` and ``kept_text``; a null text stays null."""
    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())]
    rows = without(docs, [f.name for f in added] + ["__doc", "__version", "__keep"])
    marks = bitmaps.select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), F.col("keep").alias("__keep"))
    same = (rows[f"`{id_col}`"].cast("long") == marks["__doc"]) & (F.xxhash64(rows[f"`{text_col}`"]) == marks["__version"])
    joined = rows.join(marks, same, "left").drop("__doc", "__version")
    schema = extended(rows, added)
    types = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text_col):
                sizes, gone, kept = [], [], []
                for text, keep in zip(texts, part.column("__keep").to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    if keep is not None:
                        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
                        text = "\n".join([line for line, bit in zip(lines, bits.tolist(), strict=True) if bit])
                        gone.append(len(lines) - int(bits.sum()))
                    else:
                        gone.append(0)
                    sizes.append(len(lines))
                    kept.append(text)
                yield appended(part.drop_columns(["__keep"]), [sizes, gone, kept], types)

    return joined.mapInArrow(run, schema)
