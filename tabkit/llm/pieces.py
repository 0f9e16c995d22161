"""Fill-in-the-middle by piece tables: a document becomes descriptors over buffers that are never changed.

A piece is (buffer, start, size): ``size`` bytes from ``start`` in the text (buffer 0) or in the sentinels
(buffer 1). A document begins as one piece over its text. Cutting splits a piece in two and copies nothing; an
arrangement is a permutation of pieces, sentinels among them; ``rendered`` reads an output off its pieces. The way
back cuts the output at its sentinels, takes the inverse permutation and leaves the sentinels out. Digests are fed
piece by piece from the buffers.

Units are lines with their line breaks. Where a document is cut, and in which form it goes out, follows from the
SHA-256 of seed and id alone, so every run and every task agrees. Documents never move between tasks; a task holds
one document and its output at a time.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel, is plain. A row without an id is
drawn like one whose id is an empty string. Rows that repeat an id are transformed each by itself, alike if their
texts are. An empty table gives none. Columns of the documents that bear the name of a result are replaced,
other columns are passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.llm.common import appended, arrow_schema, extended, slices, without

SEED = 7
#: Documents of a hundred that are cut, and cut documents of a hundred that have the suffix first.
RATE = 100
SUFFIX_FIRST = 50

SENTINELS = b"<P><S><M>"
TEXT, SENTINEL = 0, 1
PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK = ((SENTINEL, at, 3) for at in (0, 3, 6))
#: Places of the parts (prefix, middle, suffix) in the order of a form.
ORDER = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
MARKS = (PREFIX_MARK, MIDDLE_MARK, SUFFIX_MARK)

Piece = tuple[int, int, int]


def cut(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """Two lists of pieces: the first ``at`` bytes and the rest."""
    before = []
    for number, (buffer, start, size) in enumerate(pieces):
        if at < size:
            head = [(buffer, start, at)] if at else []
            return before + head, [(buffer, start + at, size - at), *pieces[number + 1:]]
        before.append((buffer, start, size))
        at -= size
    return before, []


def arranged(parts: list[list[Piece]], form: str) -> list[Piece]:
    """The parts in the order of a form, each behind its sentinel."""
    return [piece for part in ORDER[form] for piece in (MARKS[part], *parts[part])]


def restored(output: bytes, form: str) -> list[Piece]:
    """The pieces of an output (buffer 0) that make up its text again."""
    if form == "plain":
        return [(TEXT, 0, len(output))]
    marks = [SENTINELS[start:start + size] for _, start, size in MARKS]
    found = [output.index(marks[part]) for part in ORDER[form]]
    parts: list[Piece] = [(TEXT, 0, 0)] * len(found)
    for part, start, stop in zip(ORDER[form], found, [*found[1:], len(output)], strict=True):
        parts[part] = (TEXT, start + len(marks[part]), stop - start - len(marks[part]))
    return parts


def streamed(pieces: list[Piece], text: bytes) -> Iterator[memoryview]:
    """The bytes of each piece, as views."""
    buffers = (memoryview(text), memoryview(SENTINELS))
    for buffer, start, size in pieces:
        yield buffers[buffer][start:start + size]


def digest(pieces: list[Piece], text: bytes) -> str:
    sha = hashlib.sha256()
    for view in streamed(pieces, text):
        sha.update(view)
    return sha.hexdigest()


def characters(pieces: list[Piece], text: bytes) -> int:
    """Code points: bytes that do not continue one."""
    return sum(int(np.count_nonzero(np.frombuffer(view, np.int8) >= -64)) for view in streamed(pieces, text))


def draws(seed: int, key: object) -> list[int]:
    """Four numbers below 2**32 of a document."""
    name = "" if key is None else key
    mark = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return [int.from_bytes(mark[at:at + 4], "big") for at in range(0, 16, 4)]


def plan(key: object, text: bytes, seed: int, rate: int, suffix_first: int) -> tuple[int, str, list[list[Piece]]]:
    """The number of lines of a document, its form, and its parts: prefix, middle and suffix, or all of it."""
    whole: list[Piece] = [(TEXT, 0, len(text))] if text else []
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    units = len(ends) + (len(text) > 0 and not text.endswith(b"\n"))
    first, second, drawn, way = draws(seed, key)
    if not text or drawn % 100 >= rate or any(SENTINELS[at:at + 3] in text for at in (0, 3, 6)):
        return units, "plain", [whole]
    places = [0, *ends.tolist(), len(text)]
    low, high = sorted((places[first % (units + 1)], places[second % (units + 1)]))
    rest, suffix = cut(whole, high)
    prefix, middle = cut(rest, low)
    return units, "spm" if way % 100 < suffix_first else "psm", [prefix, middle, suffix]


ADDED = T.StructType([
    T.StructField("n_units", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("pieces", T.ArrayType(T.StructType([
        T.StructField("buffer", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("size", T.LongType()),
    ]))),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType()),
])


def transform(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """Every document with ``n_units``, ``form``, ``pieces`` (its output as a piece table), the code points of prefix
    and middle (null for a plain one), the digest of the output, and that of the text rebuilt from output and form."""
    rows = without(docs, ADDED.fieldNames())
    schema = extended(rows, ADDED.fields)
    types = arrow_schema(schema)

    def one(key: object, text: bytes) -> tuple:
        units, form, parts = plan(key, text, seed, rate, suffix_first)
        pieces = parts[0] if form == "plain" else arranged(parts, form)
        output = b"".join(streamed(pieces, text))
        sizes = (None, None) if form == "plain" else (characters(parts[0], text), characters(parts[1], text))
        table = [{"buffer": buffer, "start": start, "size": size} for buffer, start, size in pieces]
        return units, form, table, *sizes, digest(pieces, text), digest(restored(output, form), output)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text_col):
                made = [one(key, (text or "").encode()) for key, text in zip(part.column(id_col).to_pylist(), texts, strict=True)]
                yield appended(part, [list(column) for column in zip(*made, strict=True)], types)

    return rows.mapInArrow(run, schema)


def rendered(text: Column, pieces: Column) -> Column:
    """The output that a piece table stands for."""

    @F.pandas_udf("string")
    def join(texts: pd.Series, tables: pd.Series) -> pd.Series:
        out = []
        for value, table in zip(texts, tables, strict=True):
            data = (value or "").encode()
            out.append(b"".join(streamed([(p["buffer"], p["start"], p["size"]) for p in table], data)).decode())
        return pd.Series(out, dtype=object)

    return join(text, pieces)


def restore(output: Column, form: Column) -> Column:
    """The text of an output, from output and form alone."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        data = [value.encode() for value in outputs]
        return pd.Series([b"".join(streamed(restored(d, f), d)).decode() for d, f in zip(data, forms, strict=True)], dtype=object)

    return back(output, form)
