"""Byte-level BPE with a hierarchical-bitmap rank queue, and its decoder.

Pre-tokens lie one after another in an arena of linked positions. Each merge rank has a bucket of positions
whose pair has that rank; a bitmap of three levels tells the lowest rank with a bucket by three
find-first-set steps. An entry is stale, and skipped, once the pair at its position has changed. A merge costs
a constant number of queue steps whatever the length of the pre-token, so very long ones stay near linear.

Token ids travel packed as little-endian unsigned 32-bit integers, as training shards hold them.

Defined cases: a null text is an empty text without tokens; all else is encoded whole, without special
tokens. Null ids decode to empty bytes. Rows are handled one by one, so ties and repeated rows need no rule.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabkit.llm.common import appended, arrow_schema, extended, slices, without

#: Pre-tokens whose ids a task remembers; beyond, it starts anew.
REMEMBERED = 400_000
#: Pre-tokens that share an arena, so that its lists stay in the processor's cache.
ARENA = 10_000
WORD_BITS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file: a base64 token and a number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Positions by merge rank; the lowest rank is found by find-first-set on three levels of bitmap words."""

    def __init__(self, ranks: int) -> None:
        self.leaves = [0] * (ranks // WORD_BITS + 1)
        self.middle = [0] * (ranks // WORD_BITS**2 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def fill(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Enter many positions at once, given in ascending order."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        starts = np.flatnonzero(np.diff(ranks, prepend=-1))
        for rank, start, stop in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ranks)][:len(starts)], strict=True):
            self.buckets[rank] = positions[start:stop].tolist()
            self._mark(rank)

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if not bucket:
            self.buckets[rank] = [position]
            self._mark(rank)
        else:
            heappush(bucket, position)

    def _mark(self, rank: int) -> None:
        leaf = rank >> 6
        self.leaves[leaf] |= 1 << (rank & 63)
        self.middle[leaf >> 6] |= 1 << (leaf & 63)
        self.top |= 1 << (leaf >> 6)

    def first(self) -> int:
        """The lowest rank with a bucket, or -1."""
        if not self.top:
            return -1
        high = (self.top & -self.top).bit_length() - 1
        word = self.middle[high]
        leaf = (high << 6) + (word & -word).bit_length() - 1
        word = self.leaves[leaf]
        return (leaf << 6) + (word & -word).bit_length() - 1

    def clear(self, rank: int) -> None:
        leaf = rank >> 6
        self.leaves[leaf] &= ~(1 << (rank & 63))
        if not self.leaves[leaf]:
            self.middle[leaf >> 6] &= ~(1 << (leaf & 63))
            if not self.middle[leaf >> 6]:
                self.top &= ~(1 << (leaf >> 6))


class Merges:
    """A vocabulary: token ids of single bytes, ranks of pairs of ids, bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = max(ranks.values()) + 1
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.size + right] = rank
        self.of_bytes = np.full(256 * 256, -1, np.int64)
        for left in range(256):
            for right in range(256):
                self.of_bytes[left * 256 + right] = self.pairs.get(int(self.of_byte[left]) * self.size + int(self.of_byte[right]), -1)

    def encode(self, pre_tokens: list[bytes]) -> list[bytes]:
        """The packed ids of each pre-token."""
        text = np.frombuffer(b"".join(pre_tokens), np.uint8)
        lengths = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        ends = np.cumsum(lengths)
        if not len(text):
            return [b""] * len(pre_tokens)
        ids, size, pairs = self.of_byte[text].tolist(), self.size, self.pairs
        found = np.full(len(text), -1, np.int64)
        found[:-1] = self.of_bytes[text[:-1].astype(np.int64) * 256 + text[1:]]
        after, before = np.arange(1, len(text) + 1), np.arange(-1, len(text) - 1)
        filled = lengths > 0
        after[ends[filled] - 1] = -1
        before[ends[filled] - lengths[filled]] = -1
        found[ends[filled] - 1] = -1
        queue = RankQueue(size)
        open_at = np.flatnonzero(found >= 0)
        queue.fill(found[open_at], open_at)
        rank_at, after, before = found.tolist(), after.tolist(), before.tolist()
        buckets, pair, push = queue.buckets, pairs.get, queue.push
        while (rank := queue.first()) >= 0:
            bucket, lowest = buckets[rank], rank
            while bucket and lowest >= rank:
                at = heappop(bucket)
                if rank_at[at] != rank:
                    continue  # stale: the pair at this place has changed
                gone = after[at]
                right, left = after[gone], before[at]
                ids[at], ids[gone], rank_at[gone], after[at] = rank, -1, -1, right
                if right >= 0:
                    before[right] = at
                    rank_at[at] = new = pair(rank * size + ids[right], -1)
                    if new >= 0:
                        push(new, at)
                        if new < lowest:
                            lowest = new
                else:
                    rank_at[at] = -1
                if left >= 0:
                    rank_at[left] = new = pair(ids[left] * size + rank, -1)
                    if new >= 0:
                        push(new, left)
                        if new < lowest:
                            lowest = new
            if not bucket:
                del buckets[rank]
                queue.clear(rank)
        ids = np.array(ids, np.int64)
        stays = ids >= 0
        packed = ids[stays].astype("<u4").tobytes()
        counts = np.concatenate([[0], np.cumsum(stays)])[ends].tolist()
        return [packed[4 * a:4 * b] for a, b in zip([0, *counts[:-1]], counts, strict=True)]


def _ascii_twin(pattern: str) -> re.Pattern | None:
    """The pattern for texts of ASCII only, with letters and digits as plain ranges: twice as fast."""
    ranges = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}

    def plain(found: re.Match) -> str:
        if found[0] in ranges:
            return f"[{ranges[found[0]]}]"
        return found[0].replace(r"\p{L}", ranges[r"\p{L}"]).replace(r"\p{N}", ranges[r"\p{N}"])

    twin = re.sub(r"\[[^\]]*\]|\\p\{[LN]\}", plain, pattern)
    return None if r"\p" in twin else re.compile(twin, re.ASCII)


class Encoder:
    """Encodes texts and remembers the ids of pre-tokens it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED) -> None:
        self.merges = Merges(ranks)
        self.split = regex.compile(pattern).findall
        twin = _ascii_twin(pattern)
        self.split_ascii = twin.findall if twin else self.split
        self.remembered = remembered
        self.known: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        cut = [(self.split_ascii if text.isascii() else self.split)(text) if text else [] for text in texts]
        if len(self.known) > self.remembered:
            self.known.clear()
        new = list(set().union(*cut).difference(self.known))
        for start in range(0, len(new), ARENA):
            part = new[start:start + ARENA]
            self.known.update(zip(part, self.merges.encode([t.encode() for t in part]), strict=True))
        known = self.known.__getitem__
        return [b"".join(map(known, parts)) for parts in cut]


def encode(
    df: DataFrame, text_col: str, ranks: dict[bytes, int], pattern: str, *, ids_col: str = "ids", bytes_col: str | None = None,
) -> DataFrame:
    """Add the packed token ids of each text, and in ``bytes_col``, if named, what they decode to.

    One narrow pass: rows neither move nor meet one another. ``ranks`` is a vocabulary, whose size does not depend
    on the data; it is broadcast once.
    """
    added = [T.StructField(name, T.BinaryType()) for name in (ids_col, bytes_col) if name]
    rows = without(df, [f.name for f in added])
    schema = extended(rows, added)
    types, shared = arrow_schema(schema), df.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)  # of this task: idle workers hold no memory
        tokens = token_bytes(shared.value[0]) if bytes_col else []
        for batch in batches:
            for part, texts in slices(batch, text_col):
                packed = encoder.encode(texts)
                columns = [packed, decoded(packed, tokens)] if bytes_col else [packed]
                yield appended(part, columns, types)

    return rows.mapInArrow(run, schema)


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id."""
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def decoded(packed: Iterable[bytes | None], tokens: list[bytes]) -> list[bytes]:
    """What packed ids stand for."""
    return [b"".join(map(tokens.__getitem__, np.frombuffer(p, "<u4").tolist())) if p else b"" for p in packed]


def decode(df: DataFrame, ids_col: str, ranks: dict[bytes, int], *, bytes_col: str = "decoded") -> DataFrame:
    """Add the bytes that the packed ids of each row stand for."""
    rows = without(df, [bytes_col])
    schema = extended(rows, [T.StructField(bytes_col, T.BinaryType())])
    types, shared = arrow_schema(schema), df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(shared.value)
        for batch in batches:
            for part, packed in slices(batch, ids_col):
                yield appended(part, [decoded(packed, tokens)], types)

    return rows.mapInArrow(run, schema)
