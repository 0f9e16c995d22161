"""SimHash near-duplicates: fingerprints linked within a few bits by BK-trees, and their components.

Shingles of words are hashed with XXH64; a bit of the fingerprint is set if it is set in over half of the
hashes. Equal fingerprints are counted into one class first, so groups of copies never meet one another.

All classes are dealt to shards by hash, and each shard becomes one BK-tree, a table row of bounded size: the
children of a node are keyed by their Hamming distance to it, and a subtree of a few points is an array. Shard trees
are broadcast in groups of at most ``group`` points, one pass over all classes per group. A block of classes walks
a tree together: at every node each one follows only the edges within the radius of its own distance, and the
nodes that it meets are counted.

A search emits the link of a class to one representative per tree and neighbourhood (a union-find per tree and block),
so a crowd of near copies makes no table of all pairs.

Defined cases: a null or empty text has no words and fingerprint zero, linked like any other; a text of fewer
words than a shingle is one shingle. Rows that repeat a document keep a row each. A row without an id belongs
to its component without naming it; a component without any id is null. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.llm.common import appended, arrow_schema, extended, shared_folder, slices, stored
from tabkit.llm.components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Points of one tree, and of the trees of one broadcast (8 bytes each, and as much again for nodes at most).
SHARD = 1 << 17
GROUP = 1 << 20
#: Classes that walk through a tree together.
BLOCK = 1 << 13
#: Points that are compared as an array, and the depth at which a subtree becomes one whatever its size.
LEAF = 64
MOST_TASKS = 20_000
DEEPEST = 256
#: Hashes whose bits are counted at a time.
HASHES = 1 << 16
ALL_BITS = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    count = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for start in range(0, count, HASHES):
        part = hashes[start:start + HASHES]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = extended(rows.select("doc_id"), [T.StructField("fp", T.LongType())])
    types = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                yield appended(part.select(["doc_id"]), [pa.array(prints)], types)

    return rows.mapInArrow(run, schema)


def fingerprint_of(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return prints(text)


NODE = np.dtype([("point", "i4"), ("start", "i4"), ("stop", "i4"), ("first", "i4"), ("children", "i4")])
EDGE = np.dtype([("distance", "i4"), ("node", "i4")])


def grow(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A BK-tree over different points: the points in the order of its arrays, its nodes and its edges. An inner node
    has a point of its own and edges keyed by distance; a node without edges is the array start:stop."""
    order, nodes, edges = np.arange(len(points)), [], []
    waiting = [(0, len(points), -1, 0)] if len(points) else []
    while waiting:
        start, stop, edge, depth = waiting.pop()
        if edge >= 0:
            edges[edge] = (edges[edge][0], len(nodes))
        if stop - start <= LEAF or depth >= DEEPEST:
            nodes.append((-1, start, stop, 0, 0))
            continue
        own = order[start:stop]
        away = np.bitwise_count(points[own] ^ points[own[0]])
        by = np.argsort(away, kind="stable")
        own, away = own[by], away[by]
        order[start:stop] = own
        cuts = np.flatnonzero(np.diff(away)) + 1  # the point itself comes first, at distance zero
        nodes.append((start, start, stop, len(edges), len(cuts)))
        for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)], strict=True):
            waiting.append((start + low, start + high, len(edges), depth + 1))
            edges.append((int(away[low]), -1))
    return points[order], np.array(nodes, NODE), np.array(edges, EDGE)


class Groups:
    """Union-find over numbered things; the smallest number names a group."""

    def __init__(self, size: int) -> None:
        self.parent = np.arange(size)

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while True:
            above = self.parent[up]
            if (above == up).all():
                return up
            up = above

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.parent, high, low)
            # a root that met several smaller ones took the least: the others meet in the next round
            a, b = low, high
            if not len(a):
                return
            a, b = np.unique(np.stack([a, b]), axis=1)


def walk(tree: tuple[np.ndarray, np.ndarray, np.ndarray], queries: np.ndarray, radius: int, found) -> np.ndarray:
    """Search a tree for all queries at once. ``found`` is called with (query, place) arrays within the radius; the
    result is the number of points that each query was compared with."""
    points, nodes, edges = tree
    visited = np.zeros(len(queries), np.int64)
    waiting = [(0, np.arange(len(queries)))] if len(points) else []
    while waiting:
        at, asked = waiting.pop()
        point, start, stop, first, children = nodes[at]
        if not children:
            visited[asked] += stop - start
            step = max((1 << 20) // max(int(stop - start), 1), 1)
            for low in range(0, len(asked), step):
                part = asked[low:low + step]
                near = np.bitwise_count(queries[part][:, None] ^ points[start:stop][None, :]) <= radius
                query, place = np.nonzero(near)
                if len(query):
                    found(part[query], place + start)
            continue
        visited[asked] += 1
        away = np.bitwise_count(queries[asked] ^ points[point]).astype(np.int64)
        near = away <= radius
        if near.any():
            found(asked[near], np.full(int(near.sum()), point))
        for distance, below in edges[first:first + children].tolist():
            follow = asked[np.abs(away - distance) <= radius]
            if len(follow):
                waiting.append((below, follow))
    return visited


def block_links(tree: tuple[np.ndarray, np.ndarray, np.ndarray], queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a block of queries: (a, b) links that join queries and points of a tree as all pairs within the radius
    would, and the number of points that each query was compared with."""
    names = np.unique(np.concatenate([queries, tree[0]]))
    groups, own, theirs = Groups(len(names)), np.searchsorted(names, queries), np.searchsorted(names, tree[0])
    visited = walk(tree, queries, radius, lambda query, place: groups.union(own[query], theirs[place]))
    roots = groups.roots(np.arange(len(names)))
    linked = np.flatnonzero(roots != np.arange(len(names)))
    return names[linked], names[roots[linked]], visited


TREES = "shard long, points binary, nodes binary, edges binary"


def build_trees(classes: DataFrame, shard: int) -> DataFrame:
    """One stored row per shard: its tree, packed."""
    shards = max(-(-classes.count() // shard), 1)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        points, nodes, edges = grow(np.sort(part["fp"].to_numpy(np.int64)).view(np.uint64))
        row = [part["shard"].iloc[0], points.tobytes(), nodes.tobytes(), edges.tobytes()]
        return pd.DataFrame([row], columns=["shard", "points", "nodes", "edges"])

    dealt = classes.select("fp", F.pmod(F.xxhash64("fp"), F.lit(shards)).alias("shard"))
    return stored(dealt.groupBy("shard").applyInPandas(build, TREES), "bk-trees")


def _blocks(classes: DataFrame, block: int) -> DataFrame:
    """The classes as stored rows of up to ``block`` fingerprints."""
    schema = T._parse_datatype_string("queries binary")
    types = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            for start in range(0, len(prints), block):
                yield pa.RecordBatch.from_pydict({"queries": [prints[start:start + block].tobytes()]}, schema=types)

    return stored(classes.select("fp").mapInArrow(run, schema), "fingerprint-blocks")


SEARCHED = "a long, b long, visited long"


def search_trees(trees: DataFrame, classes: DataFrame, *, radius: int = RADIUS, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """Rows (a, b) that link classes within the radius, and rows (a, visited) that say how many points a class met in a
    tree. Each group of trees is one broadcast and one pass over the blocks of classes."""
    blocks, sizes = _blocks(classes, block), trees.select("shard", F.octet_length("points").alias("n")).orderBy("shard").collect()
    groups: list[list[int]] = []
    room = 0
    for row in sizes:  # one row per shard
        if not groups or room < row["n"] // 8:
            groups.append([])
            room = group
        groups[-1].append(row["shard"])
        room -= row["n"] // 8
    types, n_blocks = arrow_schema(T._parse_datatype_string(SEARCHED)), blocks.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = np.frombuffer(row["points"], np.uint64), np.frombuffer(row["nodes"], NODE), np.frombuffer(row["edges"], EDGE)
                queries = np.frombuffer(row["queries"], np.uint64)
                a, b, visited = block_links(tree, queries, radius)
                first = np.concatenate([a, queries]).view(np.int64)
                second = pa.array(np.concatenate([b, queries]).view(np.int64), mask=np.arange(len(first)) >= len(a))
                met = pa.array(np.concatenate([np.zeros(len(a), np.int64), visited]), mask=np.arange(len(first)) < len(a))
                yield pa.RecordBatch.from_arrays([pa.array(first), second, met], schema=types)

    spark, folder = classes.sparkSession, shared_folder(classes.sparkSession, "simhash-links")
    for number, shards in enumerate(groups):
        low, high = shards[0], shards[-1]
        here = F.broadcast(trees.filter(F.col("shard").between(low, high)))
        asked = blocks.select("queries", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("s"))
        # a row is a whole block against a whole tree, so few of them make a task
        tasks = min(max(n_blocks * len(shards), 1), MOST_TASKS)
        pairs = asked.repartition(tasks, F.xxhash64("queries"), "s").join(here, F.col("s") == F.col("shard")).drop("s", "shard")
        pairs.mapInArrow(run, SEARCHED).write.parquet(f"{folder}/group={number}")
    schema = T._parse_datatype_string(SEARCHED)
    return spark.read.schema(schema).parquet(*[f"{folder}/group={n}" for n in range(len(groups))]) if groups else spark.createDataFrame([], schema)


def links(classes: DataFrame, *, radius: int = RADIUS, shard: int = SHARD, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """(a, b, visited): links between different fingerprints ``fp`` that connect whatever is within the radius, and how
    many points each class was compared with (rows without ``b``)."""
    return search_trees(build_trees(classes, shard), classes, radius=radius, group=group, block=block)


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
    shard: int = SHARD,
) -> DataFrame:
    """(doc_id, fp, component_id, low, visited): every row with the smallest id that links of at most ``radius`` bits
    reach; ``low`` names the component even where no row has an id, ``visited`` counts the points of all trees that
    the fingerprint was compared with."""
    prints = stored(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    found = stored(links(classes.select("fp"), radius=radius, shard=shard), "fingerprint-links")
    low = components(found.filter("b IS NOT NULL"), "a", "b")
    joined = classes.join(low, classes["fp"] == low["node"], "left").select("fp", F.coalesce("low", "fp").alias("low"), "first")
    names = joined.groupBy("low").agg(F.min("first").alias("component_id"))
    met = found.filter("b IS NULL").groupBy(F.col("a").alias("met_by")).agg(F.sum("visited").alias("visited"))
    named = joined.join(names, "low").select(F.col("fp").alias("fp_of"), "component_id", "low")
    named = named.join(met, named["fp_of"] == met["met_by"], "left")
    return prints.join(named, prints["fp"] == named["fp_of"]).select("doc_id", "fp", "component_id", "low", "visited")
