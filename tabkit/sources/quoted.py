"""CSV records with line breaks inside quotes, read by many tasks.

A file is read as lines in blocks, which tasks take as they take any text file. Whether a line starts inside quotes
depends on all lines before it; what a line does to that state does not. So one pass finds for every block the state
that it ends in, if it starts outside and if it starts inside quotes; the states at which blocks start follow block by
block, from one small row each. A second pass picks up the pieces of records that cross the ends of blocks, and puts
them together. Then every task knows where records start in its lines, and sends them to the CSV parser.

A quote opens a field only where a field starts, a doubled quote inside is a quote, as the parser has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.session import shared_table

_OPENS = {d: re.compile(rf'(?:^|(?<={re.escape(d)}))"') for d in ",;\t|"}


def after(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether the end of a line lies inside quotes."""
    opens = _OPENS.get(delimiter) or re.compile(rf'(?:^|(?<={re.escape(delimiter)}))"')
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside, at = False, at + 1
        else:
            found = opens.search(line, at)
            if found is None:
                return False
            inside, at = True, found.end()


def _lines(spark: SparkSession, path, encoding: str) -> DataFrame:
    """(value, block): lines as they stand between line feeds; ``block`` names file and place. Lines of one block come
    one after another in one task."""
    text = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    start = F.col("_metadata.file_block_start")
    return text.select(value.alias("value"), F.col("_metadata.file_path").alias("file"), start.alias("start"), F.xxhash64("_metadata.file_path", start).alias("block"))


def _ends(lines: DataFrame, delimiter: str) -> DataFrame:
    """(file, start, block, from_out, from_in): the state at the end of each block for either state at its start."""
    schema = "file string, start long, block long, from_out boolean, from_in boolean"
    types = pa.schema([("file", pa.string()), ("start", pa.int64()), ("block", pa.int64()), ("from_out", pa.bool_()), ("from_in", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("value", "file", "start", "block")], strict=True):
                value, file, start, block = row
                if held is None or held["block"] != block:
                    if held is not None:
                        yield pa.RecordBatch.from_pylist([held], schema=types)
                    held = {"file": file, "start": start, "block": block, "from_out": False, "from_in": True}
                if '"' in value:
                    held["from_out"], held["from_in"] = after(value, held["from_out"], delimiter), after(value, held["from_in"], delimiter)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held], schema=types)

    return lines.mapInArrow(run, schema)


def _states(ends: DataFrame) -> DataFrame:
    """(block, inside, ends_inside, last): the states at which each block starts and ends, and whether its file ends with
    it. A file has one small row per block."""
    schema = "block long, inside boolean, ends_inside boolean, last boolean"
    types = pa.schema([("block", pa.int64()), ("inside", pa.bool_()), ("ends_inside", pa.bool_()), ("last", pa.bool_())])

    def walk(blocks: pa.Table) -> pa.Table:
        inside, out = False, []
        for row in sorted(blocks.to_pylist(), key=lambda r: r["start"]):
            end = row["from_in"] if inside else row["from_out"]
            out.append({"block": row["block"], "inside": inside, "ends_inside": end, "last": False})
            inside = end
        out[-1]["last"] = True
        return pa.Table.from_pylist(out, schema=types)

    return ends.groupBy("file").applyInArrow(walk, schema)


_PIECES = pa.schema([
    ("file", pa.string()), ("start", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("first", pa.bool_()),
])


def _cut(lines: DataFrame, inside: set[int], lasts: set[int], delimiter: str, kinds: tuple[str, ...]) -> DataFrame:
    """Records (kind ``whole``) and pieces of records at the ends of blocks: ``tail`` closes one that an earlier block
    opened, ``middle`` is a block without the end of a record, ``head`` is open where its block ends, unless a file ends
    there as well. ``first`` marks what a file starts with."""
    shared = lines.sparkSession.sparkContext.broadcast((inside, lasts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = file = start = None
        state = begun_inside = first = False
        held: list[str] = []
        out: list[tuple] = []

        def put(kind: str) -> None:
            if kind in kinds:
                out.append((file, start, kind, "\n".join(held), first))

        def close() -> None:
            if held:
                put("middle" if begun_inside else "whole" if block in shared.value[1] else "head")

        for batch in batches:
            for value, of, at, number in zip(*[batch.column(c).to_pylist() for c in ("value", "file", "start", "block")], strict=True):
                if number != block:
                    close()
                    block, file, start, held = number, of, at, []
                    state = begun_inside = number in shared.value[0]
                    first = at == 0
                held.append(value)
                if '"' in value:
                    state = after(value, state, delimiter)
                if not state:
                    put("tail" if begun_inside else "whole")
                    held, begun_inside, first = [], False, False
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(_PIECES.names, row, strict=True)) for row in out], schema=_PIECES)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(_PIECES.names, row, strict=True)) for row in out], schema=_PIECES)

    return lines.select("value", "file", "start", "block").mapInArrow(run, "file string, start long, kind string, value string, first boolean")


def _stitched(pieces: DataFrame) -> DataFrame:
    """Whole records from the pieces of each file, in the order of blocks; a record still open at the end of its file
    is taken as it is."""
    schema = "value string, first boolean"

    def walk(rows: pa.Table) -> pa.Table:
        order = {"tail": 0, "middle": 0, "head": 1}
        out, held, first = [], [], False
        for row in sorted(rows.to_pylist(), key=lambda r: (r["start"], order[r["kind"]])):
            if row["kind"] == "head":
                held, first = [row["value"]], row["first"]
                continue
            held.append(row["value"])
            if row["kind"] == "tail":
                out.append({"value": "\n".join(held), "first": first})
                held = []
        if held:
            out.append({"value": "\n".join(held), "first": first})
        return pa.Table.from_pylist(out, schema=pa.schema([("value", pa.string()), ("first", pa.bool_())]))

    return pieces.select("file", "start", "kind", "value", "first").groupBy("file").applyInArrow(walk, schema)


def records(spark: SparkSession, path, encoding: str = "UTF-8", delimiter: str = ",") -> DataFrame:
    """(value): the records of CSV files without their headers and without empty lines, each as it stands in its file."""
    lines = _lines(spark, path, encoding)
    states = shared_table(_states(_ends(lines, delimiter)), "csv-blocks")
    # eight bytes per block of many megabytes
    inside, lasts = ({row["block"] for row in states.filter(which).select("block").collect()} for which in ("inside", "last AND NOT inside"))
    # only blocks at whose ends a record may be open have pieces
    crossed = states.filter("ends_inside AND NOT last OR inside").select("block")
    pieces = _cut(lines.join(F.broadcast(crossed), "block", "left_semi"), inside, lasts, delimiter, ("head", "middle", "tail"))
    whole = _cut(lines, inside, lasts, delimiter, ("whole",)).select("value", "first")
    every = whole.union(_stitched(shared_table(pieces, "csv-pieces")))
    return every.filter("NOT first").select(F.regexp_replace("value", "\r$", "").alias("value")).filter(F.trim("value") != "")


def read(spark: SparkSession, path, columns: list[str], encoding: str = "UTF-8", mode: str = "FAILFAST") -> DataFrame:
    """The fields of every record as text."""
    options = {"mode": mode, "escape": '"', "multiLine": "true"}
    parsed = records(spark, path, encoding).select(F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(columns))), options).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(columns)])
