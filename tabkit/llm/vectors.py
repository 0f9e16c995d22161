"""Nearest neighbours by inner product: a vantage-point tree per shard, searched with relaxed pruning.

Vectors of one shard get one more component that brings all of them to the shard's largest norm; queries are
scaled to that norm. The order by Euclidean distance is then the order by inner product, and the triangle
inequality holds. A node keeps the distances from its vantage point to the nearest and farthest vector on
either side of the median; a side is left out if its lower bound times ``factor`` exceeds the distance of the
k-th neighbour so far. Factor one restores exact search; above one, fewer sides are visited.

The index is a table with one row per shard, of bounded size, whatever the number of vectors. Queries are a
stated set: they are packed into rows of bounded size, and each such block meets each shard by a join on the shard's
number, so nothing passes the driver and the plan is the same for any number of blocks. Every shard returns its k best
for each query, which are merged by query.

Scores are sums of products in double precision over the original vectors, the same for equal vectors.

Defined cases: vectors that are null, zero, empty or hold a null or non-finite component take no part, nor do
rows without an id. A query meets vectors of its own length only, and none of its own id. Equal rows count
once; ids that repeat with different vectors are vectors of their own. Equal scores go to the smaller id. An
empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.llm.common import arrow_schema, stored

SHARD = 4096
LEAF = 256
#: Queries in one row, and those searched together in a task.
QUERY_BLOCK = 8192
MOST_TASKS = 20_000
TOGETHER = 1024
FACTOR = 1.0

INDEX = "shard long, size int, ids binary, vectors binary, spread double, nodes binary"
FOUND = "query_id long, vec_id long, score double"
#: What a node holds: its rows, its vantage point, its sides, and the range of distances on each side.
NODE = np.dtype([
    ("start", "i4"), ("stop", "i4"), ("vantage", "i4"), ("inner", "i4"), ("outer", "i4"),
    ("inner_low", "f8"), ("inner_high", "f8"), ("outer_low", "f8"), ("outer_high", "f8"),
])


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def lifted(vectors: np.ndarray, spread: float) -> np.ndarray:
    """Vectors with one more component that gives each the norm ``spread``."""
    rest = np.sqrt(np.maximum(spread * spread - np.einsum("ij,ij->i", vectors, vectors), 0))
    return np.column_stack([vectors, rest])


def grow(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """A vantage-point tree: the order of the points by leaf, and its nodes."""
    order, nodes, waiting = np.arange(len(points)), [], [(0, len(points), -1, "")]
    while waiting:
        start, stop, above, side = waiting.pop()
        here = len(nodes)
        if above >= 0:
            nodes[above][side] = here
        node = {"start": start, "stop": stop, "vantage": -1, "inner": -1, "outer": -1}
        nodes.append(node)
        if stop - start <= leaf:
            continue
        own = order[start:stop]
        # the point farthest from the first one: a vantage point at the rim parts the others best
        vantage = own[np.argmax(((points[own] - points[own[0]]) ** 2).sum(axis=1))]
        away = np.sqrt(((points[own] - points[vantage]) ** 2).sum(axis=1))
        if away.max() == away.min():
            continue  # equal points, which no vantage point can part
        by = np.argsort(away, kind="stable")
        own, away = own[by], away[by]
        middle = len(own) // 2
        order[start:stop] = own
        node |= {"vantage": vantage, "inner_low": away[0], "inner_high": away[middle - 1], "outer_low": away[middle], "outer_high": away[-1]}
        waiting += [(start, start + middle, here, "inner"), (start + middle, stop, here, "outer")]
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    table = np.zeros(len(nodes), NODE)
    for at, node in enumerate(nodes):
        if node["vantage"] >= 0:
            node["vantage"] = place[node["vantage"]]
        for name, value in node.items():
            table[at][name] = value
    return order, table


def build_index(df: DataFrame, id_col: str, vector_col: str, *, shard: int = SHARD) -> DataFrame:
    """One row per shard: ids and vectors in the order of the leaves, the norm they share, and the tree."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().collect()  # one row per length of vector
    shards = F.lit(1)
    for row in sizes:
        shards = F.when(F.size("vector") == row["size"], row["count"] // shard + 1).otherwise(shards)
    dealt = rows.withColumn("size", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("vec_id", "size"), shards))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = part["vec_id"].to_numpy(np.int64), np.stack(part["vector"].to_numpy())
        seen = np.unique(np.column_stack([ids, (vectors + 0.0).view(np.int64)]), axis=0, return_index=True)[1]  # -0.0 is 0.0
        ids, vectors = ids[seen], vectors[seen]
        spread = float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max()))
        order, nodes = grow(lifted(vectors, spread))
        row = [part["shard"].iloc[0], part["size"].iloc[0], ids[order].tobytes(), vectors[order].tobytes(), spread, nodes.tobytes()]
        return pd.DataFrame([row], columns=["shard", "size", "ids", "vectors", "spread", "nodes"])

    return dealt.groupBy("size", "shard").applyInPandas(build, INDEX)


class Tree:
    """One shard of the index."""

    def __init__(self, row: dict) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(self.ids), -1)
        self.spread, self.nodes = row["spread"], np.frombuffer(row["nodes"], NODE)
        self.visited = 0

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score) of the k best of this shard for each query."""
        norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        best = np.full((len(queries), k), -np.inf)  # the k best scores so far, the k-th at the front
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        slack = 1e-9 * norms * self.spread
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
        while waiting:
            at, asked, bound = waiting.pop()
            # the k-th score as a distance between vectors of the common norm
            limit = np.sqrt(np.maximum(2 * self.spread**2 - 2 * self.spread * best[asked, 0] / norms[asked], 0))
            open_ = bound * factor <= limit + 1e-6 * self.spread
            asked = asked[open_]
            if not len(asked):
                continue
            node = self.nodes[at]
            if node["vantage"] < 0:
                self._leaf(node, ids, queries, asked, best, kept, slack)
                continue
            self.visited += len(asked)
            score = queries[asked] @ self.vectors[node["vantage"]]
            # a query lies in the plane of the vectors, so its distance to a lifted vector needs the score only
            away = np.sqrt(np.maximum(2 * self.spread**2 - 2 * self.spread * score / norms[asked], 0))
            inner = np.maximum(np.maximum(node["inner_low"] - away, away - node["inner_high"]), 0)
            outer = np.maximum(np.maximum(node["outer_low"] - away, away - node["outer_high"]), 0)
            inside = inner <= outer
            sides = ((node["inner"], inner), (node["outer"], outer))
            # what is pushed last is searched first: the nearer side of each query before the farther one
            for first, (side, low) in ((~inside, sides[0]), (inside, sides[1]), (~inside, sides[1]), (inside, sides[0])):
                if first.any():
                    waiting.append((int(side), asked[first], low[first]))
        return self._ranked(ids, queries, kept, best, slack, k)

    def _leaf(self, node, ids, queries, asked, best, kept, slack) -> None:
        rows = slice(int(node["start"]), int(node["stop"]))
        self.visited += len(asked) * (rows.stop - rows.start)
        scores = queries[asked] @ self.vectors[rows].T
        scores[ids[asked][:, None] == self.ids[rows][None, :]] = -np.inf
        near = scores >= (best[asked, 0] - slack[asked])[:, None]
        near &= np.isfinite(scores)
        query, point = np.nonzero(near)
        kept.append((asked[query], point + rows.start, scores[query, point]))
        better = near.any(axis=1)
        top = np.concatenate([best[asked[better]], scores[better]], axis=1)
        top.partition(top.shape[1] - best.shape[1], axis=1)
        best[asked[better]] = top[:, -best.shape[1]:]

    def _ranked(self, ids, queries, kept, best, slack, k):
        query, point, score = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.empty(0, int),) * 3
        stays = score >= best[query, 0] - slack[query]
        query, point = query[stays], point[stays]
        exact = (queries[query] * self.vectors[point]).sum(axis=1)
        order = np.lexsort((self.ids[point], -exact, query))
        query, point, exact = query[order], point[order], exact[order]
        starts = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        first = rank < k
        return ids[query[first]], self.ids[point[first]], exact[first]


def search(
    index: DataFrame, queries: DataFrame, id_col: str, vector_col: str, *, k: int, factor: float = FACTOR,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best, nearest first."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double") + 0.0)
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), vector.alias("vector"))
    asked = asked.filter(F.col("query_id").isNotNull() & usable(F.col("vector"))).distinct()
    blocks = _blocks(asked, query_block)
    shards = index.groupBy("size").agg(F.max("shard").alias("last")).collect()  # one row per length of vector
    last = F.lit(None).cast("long")
    for row in shards:
        last = F.when(F.col("size") == row["size"], row["last"]).otherwise(last)
    # the shards set the tasks: a shard's row is held while the blocks of queries pass by it
    tasks = min(max(4 * sum(row["last"] + 1 for row in shards), 1), MOST_TASKS)
    met = blocks.select("size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("shard"), "query_ids", "queries").repartition(tasks, "size", "shard")
    pairs = met.join(index.repartition(tasks, "size", "shard"), ["size", "shard"])
    types = arrow_schema(T._parse_datatype_string(FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree(row)
                ids, vectors = np.frombuffer(row["query_ids"], np.int64), np.frombuffer(row["queries"], np.float64).reshape(-1, row["size"])
                for start in range(0, len(ids), TOGETHER):
                    got = tree.search(ids[start:start + TOGETHER], vectors[start:start + TOGETHER], k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(column) for column in got], schema=types)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _blocks(asked: DataFrame, query_block: int) -> DataFrame:
    """(size, query_ids, queries): the queries in stored rows of about ``query_block``, by length of vector."""
    blocks = asked.count() // query_block + 1
    sized = asked.withColumn("size", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = part["query_id"].to_numpy(np.int64), np.stack(part["vector"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"size": [part["size"].iloc[0]], "query_ids": [ids.tobytes()], "queries": [vectors.tobytes()]})

    return stored(sized.groupBy("size", "block").applyInPandas(pack, "size int, query_ids binary, queries binary"), "query-blocks")
