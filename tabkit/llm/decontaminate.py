"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of ASCII letters and digits and of any other character beyond ASCII, A-Z in lower case. The
automaton holds every run of words of every item. Documents stream through it word by word; the state and the
longest matching length after each word tell which windows end there. A window is ``window`` consecutive words
of an item; an item of fewer words, but not none, is one window. Words inside windows are hit; hit words make
spans; a document is contaminated if its hit words reach ``coverage`` of all its words.

Before a word is streamed, pairs of neighbouring words are looked up for a whole batch at once: where a pair
occurs in no item, no longer match can cross it, so the automaton starts anew behind it. That is exact.

Items are read in blocks of bounded size, each with an automaton of its own, and documents pass once per block, in jobs
one after another, so the size of the benchmark has no limit and a task holds one automaton at a time. Documents do not
move between tasks; what later blocks find is joined to them by the digest of the text.

Defined cases: a null or empty text has no words, is never contaminated and has no spans; an item without words
has no window. An item without id hits like any other and is not listed. Repeated item ids are one item,
repeated documents are judged one by one. Without items nothing is hit. Columns of the documents that bear the
name of a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.llm.common import ASCII_UPPER, appended, arrow_schema, extended, shared_folder, slices, stored, without

WINDOW = 13
COVERAGE = 0.05
#: Bytes of item text per automaton; an item longer than that has one of its own.
BLOCK_BYTES = 1_000_000

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(ASCII_UPPER, ASCII_UPPER.lower())
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 in lower case."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the items whose windows each state stands for."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.moves: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids: list[object] = []
        sequences = []
        for item, words in items:
            if words:
                sequences.append((len(self.ids), [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]))
                self.ids.append(item)
        for _, sequence in sequences:
            state = 0
            for word in sequence:
                state = self._extend(state, word)
        self._summarise(sequences)

    def _extend(self, last: int, word: int) -> int:
        """Append a word behind state ``last``; the state of the extended sequence."""
        there = self.moves[last].get(word)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._clone(last, word, there)
        new = self._state({}, self.length[last] + 1, 0)
        while last >= 0 and word not in self.moves[last]:
            self.moves[last][word] = new
            last = self.link[last]
        if last >= 0:
            there = self.moves[last][word]
            self.link[new] = there if self.length[there] == self.length[last] + 1 else self._clone(last, word, there)
        return new

    def _state(self, moves: dict[int, int], length: int, link: int) -> int:
        self.moves.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.moves) - 1

    def _clone(self, last: int, word: int, there: int) -> int:
        copy = self._state(dict(self.moves[there]), self.length[last] + 1, self.link[there])
        self.link[there] = copy
        while last >= 0 and self.moves[last].get(word) == there:
            self.moves[last][word] = copy
            last = self.link[last]
        return copy

    def _summarise(self, sequences: list[tuple[int, list[int]]]) -> None:
        """Per state: the suffix that is a window, its items, and the nearest suffix that is a short item."""
        order = np.argsort(self.length, kind="stable").tolist()
        self.full = [-1] * len(order)
        for state in order:
            if self.length[state] >= self.window:
                up = self.link[state]
                self.full[state] = state if self.length[up] < self.window else self.full[up]
        self.owners: dict[int, set[int]] = {}
        self.short: dict[int, dict[int, set[int]]] = {}
        pairs = set()
        self.shortest = self.window
        for item, sequence in sequences:
            state = 0
            for at, word in enumerate(sequence):
                state = self.moves[state][word]
                if at:
                    pairs.add((sequence[at - 1], word))
                if at + 1 >= self.window:
                    self.owners.setdefault(self.full[state], set()).add(item)
            if len(sequence) < self.window:
                self.short.setdefault(state, {}).setdefault(len(sequence), set()).add(item)
                self.shortest = min(self.shortest, len(sequence))
        self.near = [-1] * len(order)
        for state in order:
            self.near[state] = state if state in self.short else self.near[self.link[state]] if state else -1
        codes = sorted(a * (len(self.vocabulary) + 1) + b for a, b in pairs)
        self.pairs = np.array(codes, np.int64)

    def runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of words that may hold a window: all words known, all neighbours neighbours in an item."""
        if not len(ids):
            return
        known = ids > 0
        joined = np.zeros(len(ids), bool)
        if len(self.pairs) and len(ids) > 1:
            codes = ids[:-1].astype(np.int64) * (len(self.vocabulary) + 1) + ids[1:]
            place = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            joined[1:] = (self.pairs[place] == codes) & known[:-1] & known[1:]
        starts = np.flatnonzero(known & ~joined)
        ends = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
        long_enough = ends - starts >= self.shortest
        yield from zip(starts[long_enough].tolist(), ends[long_enough].tolist(), strict=True)

    def stream(self, ids: list[int], start: int) -> Iterator[tuple[int, int, int, set[int]]]:
        """For words numbered from ``start``: (first word, end, longest match, items) of every window met."""
        state = matched = 0
        for at, word in enumerate(ids, start + 1):
            while state and word not in self.moves[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.moves[state].get(word, 0)
            matched = matched + 1 if state else 0
            if matched >= self.window:
                full = self.full[state]
                if full >= 0:
                    yield at - self.window, at, matched, self.owners.get(full, set())
            suffix = self.near[state]
            while suffix >= 0:
                for size, items in self.short[suffix].items():
                    if size <= matched:
                        yield at - size, at, matched, items
                suffix = self.near[self.link[suffix]] if suffix else -1


class Finding:
    """What was found in one document."""

    __slots__ = ("items", "longest", "spans", "words")

    def __init__(self, words: int) -> None:
        self.words, self.longest, self.spans, self.items = words, 0, [], set()


def find(automaton: Automaton, texts: list[str | None]) -> list[Finding]:
    """Scan a slice of texts at once; spans are (first word, end) pairs, merged and in order."""
    cut = [words_of(text) for text in texts]
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # an unknown word keeps neighbours apart
    ids = np.zeros(int(starts[-1]), np.int64)
    for words, start in zip(cut, starts.tolist(), strict=False):
        ids[start:start + len(words)] = np.fromiter(map(automaton.vocabulary.get, words, repeat(0)), np.int64, len(words))
    found = [Finding(size) for size in sizes.tolist()]
    for start, stop in automaton.runs(ids):
        doc = int(np.searchsorted(starts, start, side="right")) - 1
        finding, offset = found[doc], int(starts[doc])
        for first, end, matched, items in automaton.stream(ids[start:stop].tolist(), start - offset):
            finding.longest = max(finding.longest, matched)
            finding.spans.append((first, end))
            finding.items |= items
    for finding in found:
        finding.spans = merged(finding.spans)
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """The items in blocks of about ``block_bytes`` of text, one block on the driver at a time."""
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).filter("length(text) > 0")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1
    if blocks > 1:
        rows = stored(rows.withColumn("block", F.expr(f"pmod(xxhash64(item, text), {blocks})")), "items")
    for block in range(blocks if total else 0):
        part = rows.filter(F.col("block") == block) if blocks > 1 else rows
        found = [(row["item"], row["text"]) for row in part.collect()]
        if found:
            yield found


def annotate(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Every document with ``n_words``, ``n_hit``, ``longest`` (longest match of a hit), ``spans`` (hit words,
    as word numbers), ``item_ids`` (items with windows in the text, in order) and ``contaminated``."""
    item_type = items.schema[item_id_col].dataType
    span = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])
    added = [
        T.StructField("n_words", T.LongType()), T.StructField("longest", T.IntegerType()),
        T.StructField("spans", T.ArrayType(span)), T.StructField("item_ids", T.ArrayType(item_type)),
    ]
    names = [f.name for f in added]
    rows = without(docs, [*names, "n_hit", "contaminated", *_MORE])
    blocks = _blocks(items, item_id_col, item_text_col, block_bytes)
    first = next(blocks, [])
    more = _further(rows, added, blocks, text_col, window)
    rows = _pass(rows, added, first, text_col, window)
    if more is not None:
        rows = _with_further(rows, more, text_col)
    share = Fraction(coverage).limit_denominator(1_000_000)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    rows = rows.withColumn("n_hit", n_hit).withColumn("item_ids", F.array_sort(F.array_distinct("item_ids")))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (share.denominator * F.col("n_hit") >= share.numerator * F.col("n_words")))


#: What the passes after the first one found, as columns beside those of the first.
_MORE = ["__text", "__longest", "__spans", "__item_ids"]


def _further(rows: DataFrame, added: list[T.StructField], blocks: Iterator[list], text_col: str, window: int) -> DataFrame | None:
    """What further blocks of items find, by text: one job per block over the documents, each of which stores the texts
    with hits, by digest. The plan of the result does not grow with the blocks."""
    spark, folder, paths = rows.sparkSession, shared_folder(rows.sparkSession, "decontamination"), []
    texts = rows.select(F.col(f"`{text_col}`").alias("text"))
    for block in blocks:
        found = _pass(texts, added, block, "text", window).filter(F.size("spans") > 0)
        paths.append(f"{folder}/block={len(paths)}")
        found.select(F.sha2("text", 256).alias("key"), "longest", "spans", "item_ids").dropDuplicates(["key"]).write.parquet(paths[-1])
    if not paths:
        return None
    schema = T.StructType([T.StructField("key", T.StringType()), *[f for f in added if f.name != "n_words"]])
    read = spark.read.schema(schema).parquet(*paths)
    return stored(
        read.groupBy("key").agg(
            F.max("longest").alias("__longest"), F.flatten(F.collect_list("spans")).alias("__spans"), F.flatten(F.collect_list("item_ids")).alias("__item_ids")
        ), "decontamination",
    )


def _with_further(rows: DataFrame, more: DataFrame, text_col: str) -> DataFrame:
    """The rows of the first pass with what the further ones found in their texts."""
    @F.pandas_udf(rows.schema["spans"].dataType)
    def joined(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([
            [{"first": a, "end": b} for a, b in merged([(int(s["first"]), int(s["end"])) for s in [*one, *other]])] for one, other in zip(first, second, strict=True)
        ])

    keyed = rows.withColumn("__text", F.sha2(F.col(f"`{text_col}`"), 256))
    met = keyed.join(more.withColumnRenamed("key", "__key"), F.col("__text") == F.col("__key"), "left").drop("__key")
    hit = F.col("__spans").isNotNull()
    return met.select(
        *[F.col(f"`{c}`") for c in rows.columns if c not in ("longest", "spans", "item_ids")],
        F.greatest("longest", F.coalesce("__longest", F.lit(0))).alias("longest"),
        F.when(hit, joined("spans", F.coalesce("__spans", F.col("spans")))).otherwise(F.col("spans")).alias("spans"),
        F.when(hit, F.concat("item_ids", "__item_ids")).otherwise(F.col("item_ids")).alias("item_ids"),
    )


def _pass(rows: DataFrame, added: list[T.StructField], block: list, text_col: str, window: int) -> DataFrame:
    """Scan the documents for one block of items."""
    schema = extended(rows, added)
    types, shared = arrow_schema(schema), rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([(item, words_of(text)) for item, text in shared.value], window)
        for batch in batches:
            for part, texts in slices(batch, text_col):
                found = find(automaton, texts)
                items = [[automaton.ids[i] for i in sorted(f.items) if automaton.ids[i] is not None] for f in found]
                spans, longest = [f.spans for f in found], [f.longest for f in found]
                spans = [[{"first": a, "end": b} for a, b in s] for s in spans]
                yield appended(part, [[f.words for f in found], longest, spans, items], types)

    return rows.mapInArrow(run, schema)


def cut_spans(text_col: str = "text", min_longest: int = 0) -> Column:
    """The text of an annotated row without its hit words, where the longest match has ``min_longest`` words."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, hit in zip(texts, spans, strict=True):
            if text is None or hit is None or not len(hit):
                out.append(text)
                continue
            places, kept, last = [m.span() for m in WORD.finditer(text.translate(LOWER))], [], 0
            for span in hit:
                kept.append(text[last:places[span["first"]][0]])
                last = places[span["end"] - 1][1]
            out.append("".join(kept) + text[last:])
        return pd.Series(out, dtype=object)

    return F.when(F.col("longest") >= min_longest, cut(F.col(text_col), F.col("spans"))).otherwise(F.col(text_col))
