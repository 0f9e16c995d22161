"""Second-order gradient boosting over binned features.

Every feature is cut into at most ``max_bins`` bins at its quantiles, or at its values where it has no more. Rows of
equal bins and label have equal gradients in every round, so they are counted once with a weight: there are at most as
many as combinations of bins and labels, however long the table. They are stored in blocks. A level of a round is one job: each task adds the gradients and hessians of
its rows into histograms by class, node, feature and bin; histograms are summed by class and feature, the sums of one
feature meet in one task, and only its best split per node reaches the driver. Leaves are Newton steps with an L2
penalty. Several classes are boosted together with a softmax, one tree per class and round, so their
probabilities add up to one.

Margins are a function of the trees: a task replays the trees grown since the blocks were last written, and the blocks
are written anew with their margins every ``REFRESH`` rounds. A lost executor costs the repetition of its tasks. A
table of at most ``task_cells`` bins is boosted in one task by the same code, where 600 small jobs would cost more
than the work; sums differ in the order of their terms only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.session import drop_table, shared_table

MAX_BINS = 256
BLOCK_ROWS = 16_384
REFRESH = 4
#: Rows that a task puts into blocks, about.
TASK_ROWS = 1_000_000
#: Bins (different rows times features) that one task may boost by itself.
TASK_CELLS = 8_000_000
#: Numbers in the histograms that a task holds for one group of nodes.
HISTOGRAM_CELLS = 16_000_000
BLOCKS = "block long, rows int, bins binary, label binary, weight binary, margin binary"


@dataclass
class Loss:
    """The objective by its gradients: squared error (no classes), logistic (two) or softmax (more)."""

    classes: int

    @property
    def outputs(self) -> int:
        return self.classes if self.classes > 2 else 1

    def start(self, mean: float) -> float:
        """The margin of a model without trees."""
        if not self.classes:
            return mean
        share = min(max(mean, 1e-6), 1 - 1e-6)
        return float(np.log(share / (1 - share))) if self.classes <= 2 else 0.0

    def chances(self, margin: np.ndarray) -> np.ndarray:
        """Probabilities by class of margins by output."""
        if self.classes <= 2:
            one = 1 / (1 + np.exp(-np.clip(margin[:, 0], -500, 500)))
            return np.column_stack([1 - one, one])
        e = np.exp(margin - margin.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def steps(self, label: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and hessians by output."""
        if not self.classes:
            return margin - label[:, None], np.ones_like(margin)
        chance = self.chances(margin)
        if self.classes <= 2:
            chance = chance[:, 1:]
            return chance - label[:, None], np.maximum(chance * (1 - chance), 1e-16)
        truth = label[:, None] == np.arange(self.classes)[None, :]
        return chance - truth, np.maximum(2 * chance * (1 - chance), 1e-16)


class Tree:
    """A tree over bins: node ``i`` sends bins up to ``cut`` of ``feature`` to ``left``; a leaf has feature -1."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.right, self.value, self.gain = [-1], [0], [-1], [-1], [0.0], [0.0]

    def split(self, node: int, feature: int, cut: int, gain: float, values: tuple[float, float]) -> tuple[int, int]:
        children = len(self.feature), len(self.feature) + 1
        for value in values:
            for column, entry in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, value), (self.gain, 0.0)):
                column.append(entry)
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node], self.right[node] = children
        return children

    def leaves(self, columns: np.ndarray, cuts: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row; ``columns`` holds bins by feature, or values if ``cuts`` holds the thresholds of nodes."""
        feature, left, right = (np.array(a, np.intp) for a in (self.feature, self.left, self.right))
        cut = np.array(self.cut) if cuts is None else cuts
        if cuts is None:
            cut = cut.astype(columns.dtype)
        split = feature >= 0
        # a leaf leads to itself, so that every row takes as many steps as the tree is deep
        own = np.arange(len(feature))
        feature, ways = np.where(split, feature, 0), np.stack([np.where(split, right, own), np.where(split, left, own)], axis=1).ravel()
        at, row, flat = np.zeros(columns.shape[1], np.intp), np.arange(columns.shape[1]), columns.ravel()
        offset = feature * columns.shape[1]
        for _ in range(self._steps()):
            down = flat[offset[at] + row] <= cut[at]
            at = ways[2 * at + down]
        return at

    def _steps(self) -> int:
        deep = [0] * len(self.feature)
        for node, feature in enumerate(self.feature):
            if feature >= 0:
                deep[self.left[node]] = deep[self.right[node]] = deep[node] + 1
        return max(deep)

    def packed(self) -> dict:
        return {"feature": self.feature, "cut": self.cut, "left": self.left, "right": self.right, "value": self.value, "gain": self.gain}

    @classmethod
    def unpacked(cls, packed: dict) -> Tree:
        tree = cls()
        for name, column in packed.items():
            setattr(tree, name, column)
        return tree


@dataclass
class Block:
    """Some rows in memory: bins (features x rows), labels, weights, margins (rows x outputs)."""

    number: int
    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    margin: np.ndarray

    @classmethod
    def read(cls, row: dict, features: int, outputs: int, wide: bool) -> Block:
        bins = np.frombuffer(row["bins"], np.uint16 if wide else np.uint8).reshape(features, row["rows"])
        margin = np.frombuffer(row["margin"], np.float64).reshape(row["rows"], outputs)
        return cls(row["block"], bins, np.frombuffer(row["label"], np.float64), np.frombuffer(row["weight"], np.int64), margin)

    def drawn(self, round_: int, share: float, seed: int) -> np.ndarray:
        """How many of the equal rows take part in a round: the same draw wherever and whenever it is made."""
        return np.random.default_rng([seed, round_, self.number]).binomial(self.weight, share)


@dataclass
class Plan:
    """What every task needs to know."""

    loss: Loss
    sizes: list[int]  # bins of each feature
    rounds: int
    depth: int
    rate: float
    subsample: float
    penalty: float
    least: float  # hessian that a child needs
    seed: int

    @property
    def wide(self) -> bool:
        return max(self.sizes, default=1) > 256

    def advanced(self, block: Block, rounds: list[list[Tree]]) -> Block:
        """The block with the margins that further rounds of trees give it."""
        margin = block.margin
        for trees in rounds:
            margin = margin + np.column_stack([np.array(tree.value)[tree.leaves(block.bins)] for tree in trees])
        return Block(block.number, block.bins, block.label, block.weight, margin)

    def added(self, block: Block, round_: int, trees: list[Tree], nodes: list[list[int]], sums: list[np.ndarray]) -> None:
        """Add a block's gradients and hessians to ``sums``: per output (2, open nodes, all bins)."""
        g, h = self.loss.steps(block.label, block.margin)
        times = block.drawn(round_, self.subsample, self.seed) if self.subsample < 1 else block.weight
        g, h = g * times[:, None], h * times[:, None]
        for k, tree in enumerate(trees):
            place = np.full(len(tree.feature), -1)
            place[nodes[k]] = np.arange(len(nodes[k]))
            here = place[tree.leaves(block.bins)]
            rows = np.flatnonzero((here >= 0) & (times > 0))
            if not len(rows):
                continue
            every = len(rows) == len(here)
            here = here if every else here[rows]
            own = [np.ascontiguousarray(v[:, k] if every else v[rows, k]) for v in (g, h)]
            start, n = 0, len(nodes[k])
            for size, bins in zip(self.sizes, block.bins, strict=True):
                cells = here * size + (bins if every else bins[rows])
                for s, values in enumerate(own):
                    sums[k][s][:, start:start + size] += np.bincount(cells, values, n * size).reshape(n, size)
                start += size

    def best(self, sums: np.ndarray) -> list[tuple[float, int, float, float, float, float]]:
        """(gain, bin, gradient and hessian on the left, in all) of the best split of one feature for each node."""
        out = []
        for g, h in zip(sums[0], sums[1], strict=True):
            low, weight, all_g, all_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1], g.sum(), h.sum()
            gain = np.full(len(low), -np.inf)
            fits = (weight >= self.least) & (all_h - weight >= self.least)
            up_g, up_h = all_g - low[fits], all_h - weight[fits]
            gain[fits] = (low[fits] ** 2 / (weight[fits] + self.penalty) + up_g**2 / (up_h + self.penalty) - all_g**2 / (all_h + self.penalty)) / 2
            at = int(gain.argmax()) if len(gain) else 0
            top = float(gain[at]) if len(gain) else -np.inf
            # of equal gains, which rounding may part, the lowest bin
            if np.isfinite(top):
                at = int(np.flatnonzero(gain >= top - 1e-10 * max(1.0, abs(top)))[0])
            out.append((top, at, float(low[at]) if len(low) else 0.0, float(weight[at]) if len(low) else 0.0, float(all_g), float(all_h)))
        return out

    def newton(self, g: float, h: float) -> float:
        return -self.rate * g / (h + self.penalty)

    def grown(self, tree: Tree, nodes: list[int], found: dict[int, list[tuple]]) -> list[int]:
        """Split the open nodes by the best split of any feature; the children that stay open."""
        children = []
        for place, node in enumerate(nodes):
            ways = [(found[f][place], f) for f in sorted(found)]
            if not ways:
                continue
            top = max(way[0] for way, _ in ways)
            (_, _, _, _, all_g, all_h), _ = ways[0]
            if node == 0:
                tree.value[0] = self.newton(all_g, all_h)
            if not top > 1e-10:
                continue
            way, feature = next(w for w in ways if w[0][0] >= top - 1e-10 * max(1.0, abs(top)))
            gain, at, low_g, low_h, all_g, all_h = way
            values = self.newton(low_g, low_h), self.newton(all_g - low_g, all_h - low_h)
            children += tree.split(node, feature, at, gain, values)
        return children

    def fresh(self) -> tuple[list[Tree], list[list[int]]]:
        return [Tree() for _ in range(self.loss.outputs)], [[0] for _ in range(self.loss.outputs)]

    def empty(self, nodes: list[list[int]]) -> list[np.ndarray]:
        return [np.zeros((2, len(n), sum(self.sizes))) for n in nodes]


def _features(sums: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    start = 0
    for feature, size in enumerate(sizes):
        yield feature, sums[:, :, start:start + size]
        start += size


def boosted_here(blocks: list[Block], plan: Plan) -> list[list[Tree]]:
    """All rounds over blocks that one task holds."""
    rounds = []
    for number in range(plan.rounds):
        trees, nodes = plan.fresh()
        for _ in range(plan.depth):
            if not any(nodes):
                break
            sums = plan.empty(nodes)
            for block in blocks:
                plan.added(block, number, trees, nodes, sums)
            nodes = [plan.grown(t, n, {f: plan.best(s) for f, s in _features(x, plan.sizes)}) for t, n, x in zip(trees, nodes, sums, strict=True)]
        rounds.append(trees)
        blocks = [plan.advanced(block, [trees]) for block in blocks]
    return rounds


FOUND = "output int, feature int, node int, gain double, cut int, low_g double, low_h double, all_g double, all_h double"


def _level(blocks: DataFrame, plan: Plan, number: int, since: list[list[Tree]], trees: list[Tree], nodes: list[list[int]]) -> list[dict[int, list[tuple]]]:
    """The best split per output, feature and open node, from one pass over the stored blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast((plan, since, trees, nodes))
    sent = pa.schema([("output", pa.int32()), ("feature", pa.int32()), ("sums", pa.large_binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, since, trees, nodes = shared.value
        sums = plan.empty(nodes)
        for batch in batches:
            for row in batch.to_pylist():
                block = plan.advanced(Block.read(row, len(plan.sizes), plan.loss.outputs, plan.wide), since)
                plan.added(block, number, trees, nodes, sums)
        for k, held in enumerate(sums):
            for feature, part in _features(held, plan.sizes):
                if part.any():
                    yield pa.RecordBatch.from_pydict({"output": [k], "feature": [feature], "sums": [part.tobytes()]}, schema=sent)

    def settle(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, _, _, nodes = shared.value
        output, feature = (value.as_py() for value in key)
        total = np.zeros((2, len(nodes[output]), plan.sizes[feature]))
        for part in parts:
            for held in part.column("sums").to_pylist():
                total += np.frombuffer(held, np.float64).reshape(total.shape)
        rows = [(output, feature, node, *way) for node, way in enumerate(plan.best(total))]
        names = [c.split()[0] for c in FOUND.split(", ")]
        yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in rows], schema=_FOUND)

    groups = min(len(trees) * len(plan.sizes), blocks.sparkSession.sparkContext.defaultParallelism)
    packed = blocks.mapInArrow(gather, "output int, feature int, sums binary").repartition(groups, "output", "feature")
    best = packed.groupBy("output", "feature").applyInArrow(settle, FOUND).collect()  # one row per feature and open node
    found: list[dict[int, list[tuple]]] = [{} for _ in nodes]
    shared.unpersist()
    for row in sorted(best, key=lambda r: (r["output"], r["feature"], r["node"])):
        found[row["output"]].setdefault(row["feature"], []).append(tuple(row)[3:])
    return found


_FOUND = pa.schema([
    ("output", pa.int32()), ("feature", pa.int32()), ("node", pa.int32()), ("gain", pa.float64()), ("cut", pa.int32()),
    ("low_g", pa.float64()), ("low_h", pa.float64()), ("all_g", pa.float64()), ("all_h", pa.float64()),
])


def boosted(blocks: DataFrame, plan: Plan, refresh: int = REFRESH) -> list[list[Tree]]:
    """All rounds over stored blocks, one job per level."""
    rounds: list[list[Tree]] = []
    since: list[list[Tree]] = []
    for number in range(plan.rounds):
        trees, nodes = plan.fresh()
        for _ in range(plan.depth):
            if not any(nodes):
                break
            found: list[dict[int, list[tuple]]] = [{} for _ in nodes]
            # nodes in groups whose histograms a task can hold
            room = max(HISTOGRAM_CELLS // (2 * sum(plan.sizes) * len(trees)), 1)
            for start in range(0, max(map(len, nodes)), room):
                part = [n[start:start + room] for n in nodes]
                for total, here in zip(found, _level(blocks, plan, number, since, trees, part), strict=True):
                    for feature, ways in here.items():
                        total.setdefault(feature, [(-np.inf, 0, 0.0, 0.0, 0.0, 0.0)] * start).extend(ways)
            nodes = [plan.grown(t, n, f) for t, n, f in zip(trees, nodes, found, strict=True)]
        rounds.append(trees)
        since.append(trees)
        if len(since) == refresh and number + 1 < plan.rounds:
            stored, since = _rewritten(blocks, plan, since), []
            if number + 1 > refresh:
                drop_table(blocks)  # margins of an earlier round, which nothing reads any more
            blocks = stored
    return rounds


def _rewritten(blocks: DataFrame, plan: Plan, since: list[list[Tree]]) -> DataFrame:
    shared, types = blocks.sparkSession.sparkContext.broadcast((plan, since)), _BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, since = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                margin = plan.advanced(Block.read(row, len(plan.sizes), plan.loss.outputs, plan.wide), since).margin
                yield pa.RecordBatch.from_pylist([row | {"margin": margin.tobytes()}], schema=types)

    return shared_table(blocks.mapInArrow(run, BLOCKS), "boosting")


_BLOCKS = pa.schema([("block", pa.int64()), ("rows", pa.int32()), ("bins", pa.binary()), ("label", pa.binary()), ("weight", pa.binary()), ("margin", pa.binary())])


def cuts_of(df: DataFrame, features: str, max_bins: int = MAX_BINS) -> list[list[float]]:
    """Upper bounds of all bins but the last, per feature: midpoints between values, or quantiles of many."""
    values = df.select(F.posexplode(vector_to_array(F.col(features))).alias("at", "x"))
    shares = [i / max_bins for i in range(max_bins + 1)]
    found = values.groupBy("at").agg(F.percentile_approx("x", shares, 100 * max_bins).alias("q")).collect()  # one row per feature
    cuts: list[list[float]] = [[] for _ in found]
    for row in found:
        points = np.unique(np.array(row["q"], float))
        cuts[row["at"]] = ((points[:-1] + points[1:]) / 2).tolist() if len(points) < max_bins else points[:-1].tolist()
    return cuts


def blocked(df: DataFrame, features: str, label: str, cuts: list[list[float]], start: float, outputs: int, n: int) -> DataFrame:
    """The ``n`` rows in stored blocks of bins, labels, weights and first margins; rows of equal bins and label are one."""
    kind, types, width = np.uint16 if max(map(len, cuts), default=0) + 1 > 256 else np.uint8, _BLOCKS, len(cuts)
    context = df.sparkSession.sparkContext
    shared = context.broadcast([np.array(c) for c in cuts])
    rows = df.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"))
    counted = pa.schema([("bins", pa.binary()), ("y", pa.float64()), ("w", pa.int64())])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            bins = np.empty(x.shape, kind)
            for feature, bounds in enumerate(shared.value):
                bins[:, feature] = np.searchsorted(bounds, x[:, feature], side="left")
            each = [row.tobytes() for row in bins]
            yield pa.RecordBatch.from_arrays([pa.array(each, pa.binary()), batch.column("y").cast(pa.float64()), pa.array(np.ones(len(each), np.int64))], schema=counted)

    def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for part in _cut(batches, BLOCK_ROWS):
            size = part.num_rows
            number = (part.column("part")[0].as_py() << 32) + at
            at += 1
            bins = np.frombuffer(b"".join(part.column("bins").to_pylist()), kind).reshape(size, width)
            y, w = (part.column(c).to_numpy() for c in ("y", "w"))
            row = {
                "block": number, "rows": size, "bins": bins.T.tobytes(), "label": y.astype(np.float64).tobytes(),
                "weight": w.astype(np.int64).tobytes(), "margin": np.full((size, outputs), start).tobytes(),
            }
            yield pa.RecordBatch.from_pylist([row], schema=types)

    tasks = max(min(context.defaultParallelism, -(-n // BLOCK_ROWS)), -(-n // TASK_ROWS), 1)
    each = rows.mapInArrow(binned, "bins binary, y double, w long").groupBy("bins", "y").agg(F.sum("w").alias("w"))
    # in an order of their own, so that a row has the same place whenever it is stored
    each = each.repartition(tasks, "bins", "y").sortWithinPartitions("bins", "y").withColumn("part", F.spark_partition_id())
    return shared_table(each.mapInArrow(stacked, BLOCKS), "boosting")


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of ``size`` rows, the last one shorter."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= size:
            table = pa.Table.from_batches(held)
            yield table.slice(0, size)
            held = table.slice(size).to_batches()
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


class _BoostParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "probability column", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for regression", TypeConverters.toInt)
    rounds = Param(Params._dummy(), "rounds", "rounds", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "depth of a tree", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "shrinkage", TypeConverters.toFloat)
    subsample = Param(Params._dummy(), "subsample", "share of the rows per round", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "L2 penalty of leaves", TypeConverters.toFloat)
    least = Param(Params._dummy(), "least", "hessian that a child needs", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins per feature", TypeConverters.toInt)
    taskCells = Param(Params._dummy(), "taskCells", "bins that one task may boost", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(
            featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability", classes=0, rounds=100, depth=6,
            rate=0.1, subsample=1.0, penalty=1.0, least=1.0, maxBins=MAX_BINS, taskCells=TASK_CELLS, seed=42,
        )

    def get(self, name: str):
        return self.getOrDefault(self.getParam(name))


class NewtonBoost(Estimator, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """Gradient boosting with gradients and hessians, for regression, two and more classes."""

    def __init__(self, **params) -> None:
        super().__init__()
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> NewtonBoostModel:
        features, label = self.get("featuresCol"), self.get("labelCol")
        loss = Loss(self.get("classes"))
        rows, mean = dataset.agg(F.count(F.lit(1)), F.avg(label)).first()
        cuts = cuts_of(dataset, features, self.get("maxBins"))
        start = loss.start(mean or 0.0)
        plan = Plan(
            loss, [len(c) + 1 for c in cuts], self.get("rounds"), self.get("depth"), self.get("rate"), self.get("subsample"),
            self.get("penalty"), self.get("least"), self.get("seed"),
        )
        blocks = blocked(dataset, features, label, cuts, start, loss.outputs, rows)
        different = blocks.agg(F.sum("rows")).first()[0] or 0
        if different * max(len(cuts), 1) <= self.get("taskCells"):
            rounds = _in_one_task(blocks, plan)
        else:
            rounds = boosted(blocks, plan)
        trees = [[tree.packed() | {"cut": [cuts[f][c] if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut, strict=True)]} for tree in trees] for trees in rounds]
        model = NewtonBoostModel()
        names = ("featuresCol", "predictionCol", "probabilityCol", "classes")
        return model._set(trees=json.dumps(trees), start=start, width=len(cuts), **{n: self.get(n) for n in names})


def _in_one_task(blocks: DataFrame, plan: Plan) -> list[list[Tree]]:
    shared = blocks.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        held = [Block.read(row, len(plan.sizes), plan.loss.outputs, plan.wide) for batch in batches for row in batch.to_pylist()]
        held.sort(key=lambda block: block.number)
        trees = json.dumps([[tree.packed() for tree in trees] for trees in boosted_here(held, plan)])
        yield pa.RecordBatch.from_pydict({"trees": [trees]})

    packed = blocks.repartition(1).mapInArrow(run, "trees string").first()["trees"]
    return [[Tree.unpacked(tree) for tree in trees] for trees in json.loads(packed)]


class NewtonBoostModel(Model, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """The trees, as thresholds on values; scoring is a projection and works on a stream."""

    trees = Param(Params._dummy(), "trees", "trees by round and output", TypeConverters.toString)
    start = Param(Params._dummy(), "start", "margin without trees", TypeConverters.toFloat)
    width = Param(Params._dummy(), "width", "entries of the vector", TypeConverters.toInt)

    def _grown(self) -> list[list[tuple[Tree, np.ndarray]]]:
        rounds = [[Tree.unpacked(tree) for tree in trees] for trees in json.loads(self.get("trees"))]
        return [[(tree, np.array(tree.cut, float)) for tree in trees] for trees in rounds]

    @property
    def numFeatures(self) -> int:
        return self.get("width")

    @property
    def getNumTrees(self) -> int:
        return sum(len(trees) for trees in json.loads(self.get("trees")))

    @property
    def featureImportances(self) -> DenseVector:
        """Mean gain of the splits of each feature, as shares."""
        total, times = np.zeros(self.get("width")), np.zeros(self.get("width"))
        for trees in json.loads(self.get("trees")):
            for tree in trees:
                for feature, gain in zip(tree["feature"], tree["gain"], strict=True):
                    if feature >= 0:
                        total[feature] += gain
                        times[feature] += 1
        mean = np.divide(total, times, out=np.zeros_like(total), where=times > 0)
        return DenseVector(mean / mean.sum() if mean.sum() else mean)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        loss, start = Loss(self.get("classes")), self.get("start")
        shared = dataset.sparkSession.sparkContext.broadcast(self._grown())

        @F.pandas_udf("array<double>")
        def margins(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            columns = np.ascontiguousarray(np.stack(x.to_numpy()).T)
            out = np.full((len(x), loss.outputs), start)
            for trees in shared.value:
                for k, (tree, cuts) in enumerate(trees):
                    out[:, k] += np.array(tree.value)[tree.leaves(columns, cuts)]
            return pd.Series(list(loss.chances(out) if loss.classes else out))

        found = margins(vector_to_array(F.col(self.get("featuresCol"))))
        if not loss.classes:
            return dataset.withColumn(self.get("predictionCol"), found[0])
        told = dataset.withColumn("_chances", found)
        best = F.array_position("_chances", F.array_max("_chances")).cast("double") - 1
        return told.withColumn(self.get("probabilityCol"), array_to_vector("_chances")).withColumn(self.get("predictionCol"), best).drop("_chances")
