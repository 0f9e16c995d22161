"""Quality rules: what a text is made of, and how often its lines stand in other documents of its host.

Base rules look at one document: too few words, or too many words inside repeated three-word windows. The frequency
rule looks across documents: lines are normalised (A-Z in lower case, every digit 0, runs of ASCII white space one
space, none at the ends) and hashed; the distinct documents of a host that hold a line are counted. A line above
both limits, ``max_docs`` documents and ``max_share`` of the host's documents, is taken out of every document of
that host. A document is depleted if this takes more than ``max_removed`` of its words or leaves fewer than
``min_words``. It is kept if no base rule fails and it is not depleted.

Texts are read once; the measures, line hashes and words per line go to the shared folder. Documents of one host
with equal texts are one document, so that copies, which are another operator's matter, do not turn prose into
boilerplate. Counts are pre-aggregated by host, line and text, then by host and line, so neither a host nor a line
that a third of all documents share meets in one task. Lines above the limits, which may be many over many hosts,
are broadcast while their number is at most ``broadcast_rows`` and joined under salts beyond it, with equal results.

Defined cases: a null text has no words and fails the base rules; so does an empty one. Lines without a word are
neither counted nor removed. Rows without a host share a host of their own. Rows that repeat an id are documents of
their own, and rows that repeat a text on a host weigh once. A line on a limit stays. An empty table gives none.
Further columns are ignored by ``judge`` and passed on by ``cleaned``.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.llm.common import appended, arrow_schema, extended, met, slices, stored, without

MAX_DOCS = 10
MAX_SHARE = 0.01
MAX_REMOVED = 0.5
MIN_WORDS = 50
MAX_REPEATED = 0.5
WINDOW = 3

#: Rows of a table, or line hashes in them, that may be broadcast: 40 bytes each, names of hosts apart.
BROADCAST_ROWS = 500_000
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that stand twice or more in the text."""
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(word, len(numbers)) for word in words), np.int64, len(words))
    size, count = len(numbers), len(words) - window + 1
    codes, width = ids[:count], size
    for step in range(1, window):
        if width > (1 << 62) // size:  # too wide for a long: number the windows so far
            codes = np.unique(codes, return_inverse=True)[1]
            width = count
        codes, width = codes * size + ids[step:step + count], width * size
    _, place, times = np.unique(codes, return_inverse=True, return_counts=True)
    again = times[place] > 1
    covered = np.zeros(len(words), bool)
    for step in range(window):
        covered[step:step + count] |= again
    return int(covered.sum())


def normalised(line: bytes) -> bytes:
    return b" ".join(line.split()).translate(_PLAIN)


def measures(text: str | None) -> tuple[int, int, int, int, int, dict[bytes, int]]:
    """Words, their code points, symbols, repeated lines, repeated words, and the words under each line hash."""
    data = (text or "").encode()
    words = data.split()
    solid = len(text or "") - (len(data) - len(data.translate(None, _SPACE)))
    seen: set[bytes] = set()
    twice, lines = 0, {}
    for line in data.split(b"\n"):
        cut = line.split()
        if cut:
            twice += line in seen
            seen.add(line)
            key = xxhash.xxh3_128_digest(b" ".join(cut).translate(_PLAIN))
            lines[key] = lines.get(key, 0) + len(cut)
    return len(words), solid, len(data) - len(data.translate(None, _SYMBOLS)), twice, repeated_words(words), lines


MEASURED = T.StructType([
    *[T.StructField(name, T.LongType()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("lines", T.ArrayType(T.BinaryType())), T.StructField("line_words", T.ArrayType(T.IntegerType())),
])


def measured(docs: DataFrame, *, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, host, version, measures, lines, line_words) of every document; ``version`` is a hash of the text."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.xxhash64(text_col).alias("version"),
        F.col(text_col).alias("text"),
    )
    schema = extended(rows.drop("text"), MEASURED.fields)
    types = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                found = [measures(text) for text in texts]
                columns = [list(c) for c in zip(*[f[:5] for f in found], strict=True)]
                columns += [[list(f[5]) for f in found], [list(f[5].values()) for f in found]]
                yield appended(part.drop_columns(["text"]), columns, types)

    return rows.mapInArrow(run, schema)


def frequent_lines(lines: DataFrame, hosts: DataFrame, *, max_docs: int, max_share: float, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(host, line, n_docs): lines above both limits, of (host, line, version) rows that are distinct and of the
    number of documents ``n_host`` of each host."""
    counted = lines.groupBy("host", "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > max_docs)
    share = Fraction(max_share).limit_denominator(1_000_000)
    many = met(stored(counted, "line-counts"), hosts, ["host"], "inner", broadcast_rows)
    return many.filter(share.denominator * F.col("n_docs") > share.numerator * F.col("n_host")).drop("n_host")


def judge(
    docs: DataFrame, *, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_docs: int = MAX_DOCS,
    max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED, min_words: int = MIN_WORDS, max_repeated: float = MAX_REPEATED,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Every document's id, host and ``version`` with its measures, ``removed`` (hashes of the lines to take out),
    ``removed_words``, ``base_failed``, ``depleted`` and ``kept``."""
    known = stored(measured(docs, id_col=id_col, host_col=host_col, text_col=text_col), "line-measures")
    each = F.explode(F.arrays_zip("lines", "line_words")).alias("l")
    found = known.select("host", "version", each).select("host", "version", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    lines = stored(found.groupBy("host", "line", "version").agg(F.max("words").alias("words")), "host-lines")
    texts = known.filter("n_words > 0").select("host", "version").distinct()
    hosts = stored(texts.groupBy("host").agg(F.count("*").alias("n_host")), "host-sizes")
    above = stored(frequent_lines(lines, hosts, max_docs=max_docs, max_share=max_share, broadcast_rows=broadcast_rows).drop("n_docs"), "frequent-lines")
    taken = met(lines, above, ["host", "line"], "inner", broadcast_rows).groupBy("host", "version").agg(
        F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed")
    )
    judged = met(known.drop("lines", "line_words"), stored(taken, "removed-lines"), ["host", "version"], "left", broadcast_rows, 1 + F.size("removed"))
    judged = judged.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    judged = judged.withColumn("removed", F.coalesce("removed", F.array().cast("array<binary>")))
    repeated, removed = (Fraction(x).limit_denominator(1_000_000) for x in (max_repeated, max_removed))
    base = (F.col("n_words") < min_words) | (repeated.denominator * F.col("n_repeat_words") > repeated.numerator * F.col("n_words"))
    emptied = (removed.denominator * F.col("removed_words") > removed.numerator * F.col("n_words")) | (F.col("n_words") - F.col("removed_words") < min_words)
    judged = judged.withColumn("base_failed", base).withColumn("depleted", (F.col("removed_words") > 0) & emptied)
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose hashes are listed."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, listed: pd.Series) -> pd.Series:
        out = []
        for value, hashes in zip(texts, listed, strict=True):
            if value is not None and hashes is not None and len(hashes):
                gone = {bytes(h) for h in hashes}
                lines = [(line, normalised(line.encode())) for line in value.split("\n")]
                value = "\n".join([line for line, key in lines if not key or xxhash.xxh3_128_digest(key) not in gone])
            out.append(value)
        return pd.Series(out, dtype=object)

    return cut(text, removed)


def cleaned(docs: DataFrame, judged: DataFrame, *, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents that ``judge`` keeps, without the lines above the limits."""
    rows = without(docs, ["__id", "__host", "__version", "__removed"])
    marks = judged.filter("kept").select(
        F.col("doc_id").alias("__id"), F.col("host").alias("__host"), F.col("version").alias("__version"), F.col("removed").alias("__removed")
    ).dropDuplicates(["__id", "__host", "__version"])
    same = (
        rows[f"`{id_col}`"].eqNullSafe(marks["__id"]) & rows[f"`{host_col}`"].cast("string").eqNullSafe(marks["__host"])
        & (F.xxhash64(rows[f"`{text_col}`"]) == marks["__version"])
    )
    text = without_lines(F.col(f"`{text_col}`"), F.col("__removed"))
    return rows.join(marks, same).withColumn(text_col, text).drop("__id", "__host", "__version", "__removed")
