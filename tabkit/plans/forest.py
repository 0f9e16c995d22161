"""Random forests over binned features.

Every feature is cut into at most ``max_bins`` bins: between its values where it has no more, at its quantiles otherwise.
Rows of equal bins and label are counted once; how often a tree draws them is Poisson of their count, which is the sum of
the Poisson draws of the single rows. A row is stored as the bins that differ from the bin of zero in its feature, so
one-hot columns cost what is set in them.

A tree starts level by level: one job adds histograms of all nodes that hold more than a task may (all trees in the same
passes), the sums of a node meet in one task, and only its best split reaches the driver. A node that fits into a
task is sent there with its rows once and grown to its leaves. Draws and feature choices depend on seed, tree, block and
the path to the node only, so a repeated task repeats them, and nodes are the same wherever they are grown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.session import shared_table

MAX_BINS = 32
BLOCK_ROWS = 16_384
#: Rows that a task puts into blocks, about.
TASK_ROWS = 1_000_000
#: Stored bins in a node that one task may hold.
TASK_CELLS = 2_000_000
#: Numbers in the histograms that a task holds at a time: over the blocks, and inside a node that it grows.
HISTOGRAM_CELLS = 8_000_000
NODE_CELLS = 1_000_000
#: Quantiles that one aggregate finds.
WIDE = 50
BLOCKS = "block long, rows int, lengths binary, codes binary, label binary, weight binary"
_BLOCKS = pa.schema([("block", pa.int64()), ("rows", pa.int32()), *((c, pa.binary()) for c in ("lengths", "codes", "label", "weight"))])


@dataclass
class Plan:
    """What every task needs to know. A code is a bin of a feature, counted through all features."""

    classes: int  # 0 for regression
    start: np.ndarray  # first code of each feature, and the number of codes
    usual: np.ndarray  # the code of each feature that is not stored: the bin of zero
    trees: int
    depth: int
    least: int
    subset: int  # features tried at a node
    seed: int
    center: float  # taken off the labels of a regression
    prior: np.ndarray  # values of a tree that draws no row

    @property
    def features(self) -> int:
        return len(self.usual)

    @property
    def codes(self) -> int:
        return int(self.start[-1])

    @property
    def owner(self) -> np.ndarray:
        """The feature of each code."""
        return np.repeat(np.arange(self.features), np.diff(self.start))

    @property
    def sums(self) -> int:
        """Numbers kept for a node: draws by class, or draws and the sum of their labels."""
        return self.classes or 2

    def drawn(self, tree: int, block: int, weight: np.ndarray) -> np.ndarray:
        return np.random.default_rng([self.seed, tree, block]).poisson(weight)

    def tried(self, tree: int, paths: np.ndarray) -> np.ndarray | None:
        """Which features each node may split by, from a hash of its path; ``None`` for all."""
        if self.subset >= self.features:
            return None
        root = np.uint64((self.seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
        key = _mixed(_mixed(paths.astype(np.uint64) + root)[:, None] + np.arange(1, self.features + 1, dtype=np.uint64)[None, :])
        chosen = np.zeros(key.shape, bool)
        np.put_along_axis(chosen, np.argpartition(key, self.subset - 1, axis=1)[:, :self.subset], True, axis=1)
        return chosen

    def histograms(self, rows: Rows, here: np.ndarray, m: int, present: bool = False) -> np.ndarray:
        """Sums by node, code and kind over the rows whose node ``here`` lies in 0 to m - 1, usual bins left out; the
        last code holds the sums of the node. ``present`` adds how many different rows there are."""
        wide, kinds = self.codes + 1, self.sums + present
        out = np.empty((m, wide, kinds))
        inside = (here >= 0) & (here < m)
        row = np.flatnonzero(inside)
        keep = inside[rows.row]
        entry = rows.row[keep]
        at = np.concatenate([here[entry].astype(np.int64) * wide + rows.code[keep], here[row].astype(np.int64) * wide + self.codes])
        source = np.concatenate([entry, row])
        if self.classes:
            cells = at * self.classes + rows.label[source].astype(np.int64)
            out[:, :, :self.classes] = np.bincount(cells, rows.weight[source], m * wide * self.classes).reshape(m, wide, self.classes)
        else:
            w = rows.weight[source]
            out[:, :, 0] = np.bincount(at, w, m * wide).reshape(m, wide)
            out[:, :, 1] = np.bincount(at, w * rows.label[source], m * wide).reshape(m, wide)
        if present:
            out[:, :, -1] = np.bincount(at, minlength=m * wide).reshape(m, wide)
        return out

    def best(self, sums: np.ndarray, tree: int, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Gain and code of the best split of each node (rows up to that code go left), the sums left of it and in all."""
        total, held = sums[:, -1], sums[:, :-1].copy()
        # the usual bin of a feature has what its other bins have not
        held[:, self.usual] = total[:, None] - np.add.reduceat(held, self.start[:-1], axis=1)
        low = np.cumsum(held, axis=1)
        before = np.concatenate([np.zeros_like(low[:, :1]), low], axis=1)[:, self.start[:-1]]
        low -= np.repeat(before, np.diff(self.start), axis=1)
        n_low, score_low = self._scored(low)
        n_high, score_high = self._scored(total[:, None] - low)
        n, score = self._scored(total)
        gain = np.where((n_low >= self.least) & (n_high >= self.least), score_low + score_high - score[:, None], -np.inf)
        chosen = self.tried(tree, paths)
        if chosen is not None:
            gain[~chosen[:, self.owner]] = -np.inf
        top = gain.max(axis=1)
        # of equal gains, which rounding may part, the lowest code
        at = (gain >= (top - 1e-10 * np.maximum(1.0, np.abs(top)))[:, None]).argmax(axis=1)
        return top, at, low[np.arange(len(low)), at], total

    def _scored(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws, and draws times impurity but for what all splits share: squares of the classes or of the sum over the draws."""
        if self.classes:
            n = sums[..., :self.classes].sum(axis=-1)
            squares = (sums[..., :self.classes] ** 2).sum(axis=-1)
        else:
            n, squares = sums[..., 0], sums[..., 1] ** 2
        return n, np.divide(squares, n, out=np.zeros_like(squares), where=n > 0.5)

    def draws(self, sums: np.ndarray) -> np.ndarray:
        return sums[..., :self.classes].sum(axis=-1) if self.classes else sums[..., 0]

    def gains(self, top: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Whether a split is worth more than rounding."""
        return top > 1e-10 * np.maximum(1.0, self._scored(total)[1])

    def open(self, sums: np.ndarray, level: int) -> np.ndarray:
        """Whether nodes of these sums may be split."""
        may = (self.draws(sums) >= 2 * self.least) & (level < self.depth)
        if self.classes:
            may &= (sums[..., :self.classes] > 0).sum(axis=-1) > 1
        return may

    def values(self, sums: np.ndarray) -> np.ndarray:
        """Shares of the classes, or the mean."""
        n = np.maximum(self.draws(sums), 1e-300)[:, None]
        return sums[:, :self.classes] / n if self.classes else sums[:, 1:2] / n + self.center

    def left(self, rows: Rows, cut: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Whether each active row goes left, given the code by which its node splits."""
        feature = np.where(active, self.owner[cut], -1)
        code = self.usual[np.maximum(feature, 0)]
        named = self.owner[rows.code] == feature[rows.row]
        code[rows.row[named]] = rows.code[named]
        return code <= cut


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Rows:
    """Rows in memory: the row and code of each stored bin, labels and weights by row."""

    row: np.ndarray
    code: np.ndarray
    label: np.ndarray
    weight: np.ndarray

    @classmethod
    def read(cls, parts: list[dict]) -> Rows:
        lengths, code, label, weight = (
            np.concatenate([np.frombuffer(p[name], kind) for p in parts])
            for name, kind in (("lengths", np.int32), ("codes", np.int32), ("label", np.float64), ("weight", np.int64))
        )
        return cls(np.repeat(np.arange(len(label)), lengths), code, label, weight)

    def some(self, keep: np.ndarray, weight: np.ndarray | None = None) -> Rows:
        """The rows of a mask."""
        place = np.cumsum(keep) - 1
        stored = keep[self.row]
        return Rows(place[self.row[stored]], self.code[stored], self.label[keep], (self.weight if weight is None else weight)[keep])

    def packed(self) -> dict:
        lengths = np.bincount(self.row, minlength=len(self.label)).astype(np.int32)
        return {"lengths": lengths.tobytes(), "codes": self.code.tobytes(), "label": self.label.tobytes(), "weight": self.weight.tobytes()}


@dataclass
class Tree:
    """Nodes in arrays: a node sends codes up to ``cut`` to ``left``, others to the node after it; a leaf has left -1."""

    cut: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    def packed(self) -> dict:
        return {"cut": self.cut.tobytes(), "left": self.left.tobytes(), "gain": self.gain.tobytes(), "value": self.value.tobytes()}

    @classmethod
    def unpacked(cls, row: dict, width: int) -> Tree:
        cut, left = (np.frombuffer(row[name], np.int32) for name in ("cut", "left"))
        return cls(cut, left, np.frombuffer(row["gain"]), np.frombuffer(row["value"]).reshape(-1, width))


def grown(rows: Rows, plan: Plan, tree: int, path: int, level: int) -> Tree:
    """The tree below a node whose rows one task holds, with their draws as weights."""
    here = np.zeros(len(rows.label), np.int64)
    paths, made = np.array([path], np.uint64), 1
    cuts, lefts, gains, values = [], [], [], []
    room = max(NODE_CELLS // ((plan.codes + 1) * plan.sums), 1)
    while len(paths):
        m = len(paths)
        cut, left, gain = np.zeros(m, np.int32), np.full(m, -1, np.int32), np.zeros(m)
        low, total = np.zeros((m, plan.sums)), np.zeros((m, plan.sums))
        for first in range(0, m, room):
            end = min(first + room, m)
            sums = plan.histograms(rows, here - first, end - first)
            top, at, low[first:end], total[first:end] = plan.best(sums, tree, paths[first:end])
            split = plan.gains(top, total[first:end]) & plan.open(total[first:end], level)
            cut[first:end], gain[first:end], left[first:end] = np.where(split, at, 0), np.where(split, top, 0.0), np.where(split, 0, -1)
        split = left == 0
        left[split] = made + 2 * np.arange(split.sum())
        cuts.append(cut), lefts.append(left), gains.append(gain), values.append(plan.values(total))
        made += 2 * int(split.sum())
        if not split.any():
            break
        keep = split[here]
        rows, here = rows.some(keep), here[keep]
        down = plan.left(rows, cut[here], np.ones(len(here), bool))
        here = 2 * (np.cumsum(split) - 1)[here] + ~down
        paths = np.repeat(paths[split] * np.uint64(2), 2) + np.tile(np.array([0, 1], np.uint64), int(split.sum()))
        level += 1
    return Tree(np.concatenate(cuts), np.concatenate(lefts), np.concatenate(gains), np.concatenate(values))


@dataclass
class Top:
    """The first levels of a tree, on the driver: splits by node, and the nodes that tasks are to grow."""

    tree: int
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    gain: list[float] = field(default_factory=lambda: [0.0])
    path: list[int] = field(default_factory=lambda: [1])
    level: list[int] = field(default_factory=lambda: [0])
    leaf: dict[int, np.ndarray] = field(default_factory=dict)  # values of the nodes that stay leaves

    def split(self, node: int, cut: int, gain: float) -> int:
        self.cut[node], self.gain[node], self.left[node] = cut, gain, len(self.cut)
        for side in (0, 1):
            self.cut.append(0), self.left.append(-1), self.gain.append(0.0)
            self.path.append(2 * self.path[node] + side), self.level.append(self.level[node] + 1)
        return self.left[node]

    def places(self, rows: Rows, plan: Plan) -> np.ndarray:
        """The node that each row has reached."""
        cut, left = np.array(self.cut), np.array(self.left)
        at = np.zeros(len(rows.label), np.int64)
        for _ in range(max(self.level)):
            active = left[at] >= 0
            if not active.any():
                break
            down = plan.left(rows, cut[at], active)
            at = np.where(active, left[at] + ~down, at)
        return at


def _level(blocks: DataFrame, plan: Plan, tops: list[Top], nodes: list[tuple[int, int]]) -> list[dict]:
    """The best split of each node (tree, node), from one pass over the stored blocks."""
    shared = blocks.sparkSession.sparkContext.broadcast((plan, tops, nodes))
    kinds = plan.sums + 1
    sent = pa.schema([("slot", pa.int32()), ("sums", pa.large_binary())])
    told = pa.schema([("slot", pa.int32()), ("gain", pa.float64()), ("cut", pa.int32()), ("low", pa.list_(pa.float64())), ("total", pa.list_(pa.float64()))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, tops, nodes = shared.value
        slots: dict[int, list[int]] = {}
        for slot, (tree, _) in enumerate(nodes):
            slots.setdefault(tree, []).append(slot)
        sums = np.zeros((len(nodes), plan.codes + 1, kinds))
        for batch in batches:
            for block in batch.to_pylist():
                rows = Rows.read([block])
                for tree, own in slots.items():
                    place = np.full(len(tops[tree].cut), -1)
                    place[[nodes[s][1] for s in own]] = np.arange(len(own))
                    here, weight = place[tops[tree].places(rows, plan)], plan.drawn(tree, block["block"], rows.weight)
                    here[weight == 0] = -1
                    sums[own] += plan.histograms(Rows(rows.row, rows.code, rows.label, weight), here, len(own), present=True)
        for slot, held in enumerate(sums):
            if held.any():
                yield pa.RecordBatch.from_pydict({"slot": [slot], "sums": [held.tobytes()]}, schema=sent)

    def settle(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, tops, nodes = shared.value
        slot = key[0].as_py()
        total = np.zeros((1, plan.codes + 1, kinds))
        for part in parts:
            for held in part.column("sums").to_pylist():
                total += np.frombuffer(held).reshape(total.shape)
        tree, node = nodes[slot]
        top, at, low, every = plan.best(total, tree, np.array([tops[tree].path[node]], np.uint64))
        split = plan.gains(top, every) & plan.open(every, tops[tree].level[node])
        row = {"slot": slot, "gain": float(top[0]) if split[0] else 0.0, "cut": int(at[0]), "low": low[0].tolist(), "total": every[0].tolist()}
        yield pa.RecordBatch.from_pylist([row], schema=told)

    groups = min(len(nodes), 4 * blocks.sparkSession.sparkContext.defaultParallelism)
    packed = blocks.mapInArrow(gather, "slot int, sums binary").repartition(groups, "slot")
    found = packed.groupBy("slot").applyInArrow(settle, "slot int, gain double, cut int, low array<double>, total array<double>").collect()  # one row per node
    shared.unpersist()
    return sorted((row.asDict() for row in found), key=lambda row: row["slot"])


def forest(blocks: DataFrame, plan: Plan, different: int, stored: int, task_cells: int = TASK_CELLS) -> list[Tree]:
    """All trees over stored blocks of so many different rows and stored bins."""
    tops = [Top(tree) for tree in range(plan.trees)]
    each = max(stored / max(different, 1), 1.0)  # stored bins of a row
    small: list[tuple[int, int]] = []
    large = [(tree, 0) for tree in range(plan.trees)]
    if different * each <= task_cells:
        small, large = large, []
    room = max(HISTOGRAM_CELLS // ((plan.codes + 1) * (plan.sums + 1)), 1)
    while large:
        further: list[tuple[int, int]] = []
        for first in range(0, len(large), room):
            part = large[first:first + room]
            for row in _level(blocks, plan, tops, part):
                tree, node = part[row["slot"]]
                low, total = np.array(row["low"]), np.array(row["total"])
                if not row["gain"]:
                    tops[tree].leaf[node] = plan.values(total[None, :])[0]
                    continue
                child = tops[tree].split(node, row["cut"], row["gain"])
                for at, sums in ((child, low), (child + 1, total - low)):
                    if not plan.open(sums, tops[tree].level[at]):
                        tops[tree].leaf[at] = plan.values(sums[None, :])[0]
                    else:
                        (further if sums[-1] * each > task_cells else small).append((tree, at))
        large = further
    return _joined(plan, tops, _finished(blocks, plan, tops, small))


def _finished(blocks: DataFrame, plan: Plan, tops: list[Top], nodes: list[tuple[int, int]]) -> dict[tuple[int, int], Tree]:
    """The trees below nodes that fit into a task, each grown where the rows of its node meet."""
    if not nodes:
        return {}
    shared = blocks.sparkSession.sparkContext.broadcast((plan, tops, nodes))
    names = ("lengths", "codes", "label", "weight")
    sent = pa.schema([("slot", pa.int32()), ("block", pa.int64()), *((n, pa.binary()) for n in names)])
    told = pa.schema([("slot", pa.int32()), *((n, pa.binary()) for n in ("cut", "left", "gain", "value"))])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, tops, nodes = shared.value
        slots: dict[int, list[int]] = {}
        for slot, (tree, _) in enumerate(nodes):
            slots.setdefault(tree, []).append(slot)
        for batch in batches:
            for block in batch.to_pylist():
                rows = Rows.read([block])
                for tree, own in slots.items():
                    place = np.full(len(tops[tree].cut), -1)
                    place[[nodes[s][1] for s in own]] = own
                    here, weight = place[tops[tree].places(rows, plan)], plan.drawn(tree, block["block"], rows.weight)
                    here[weight == 0] = -1
                    for slot in np.unique(here[here >= 0]).tolist():
                        row = {"slot": slot, "block": block["block"], **rows.some(here == slot, weight).packed()}
                        yield pa.RecordBatch.from_pylist([row], schema=sent)

    def grow(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, tops, nodes = shared.value
        slot = key[0].as_py()
        held = sorted((row for part in parts for row in part.to_pylist()), key=lambda row: row["block"])
        tree, node = nodes[slot]
        below = grown(Rows.read(held), plan, tree, tops[tree].path[node], tops[tree].level[node])
        yield pa.RecordBatch.from_pylist([{"slot": slot, **below.packed()}], schema=told)

    # a task per node, up to many more than there are cores, so that the large ones do not meet
    groups = min(len(nodes), 16 * blocks.sparkSession.sparkContext.defaultParallelism)
    rows = blocks.mapInArrow(scatter, "slot int, block long, " + ", ".join(f"{n} binary" for n in names)).repartition(groups, "slot")
    found = rows.groupBy("slot").applyInArrow(grow, "slot int, cut binary, left binary, gain binary, value binary").collect()  # the forest itself
    shared.unpersist()
    return {nodes[row["slot"]]: Tree.unpacked(row.asDict(), plan.classes or 1) for row in found}


def _joined(plan: Plan, tops: list[Top], below: dict[tuple[int, int], Tree]) -> list[Tree]:
    """Whole trees from their first levels and what tasks grew below them."""
    trees = []
    for top in tops:
        n = len(top.cut)
        cut, left, gain = [np.array(top.cut, np.int32)], [np.array(top.left, np.int32)], [np.array(top.gain)]
        value = [np.tile(plan.prior, (n, 1))]
        for node, told in top.leaf.items():
            value[0][node] = told
        size = n
        for node in range(n):
            tree = below.get((top.tree, node))
            if tree is None:
                continue
            # the root of the part takes the place of the node, the others follow
            cut[0][node], gain[0][node], value[0][node] = tree.cut[0], tree.gain[0], tree.value[0]
            moved = np.where(tree.left >= 0, tree.left + size - 1, -1).astype(np.int32)
            left[0][node] = moved[0]
            cut.append(tree.cut[1:]), left.append(moved[1:]), gain.append(tree.gain[1:]), value.append(tree.value[1:])
            size += len(tree.cut) - 1
        trees.append(Tree(*(np.concatenate(a) for a in (cut, left, gain, value))))
    return trees


def cuts_of(df: DataFrame, features: str, width: int, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Upper bounds of all bins but the last, per feature: midpoints between values, or quantiles of many."""
    found_schema = pa.schema([("at", pa.int32()), ("x", pa.float64())])

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Up to ``max_bins`` + 1 different values of each feature."""
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            _, at, x = _entries(batch.column("v"), width)
            stored = np.bincount(at, minlength=width)
            order = np.lexsort((x, at))
            at, x = at[order], x[order]
            new = np.r_[True, (at[1:] != at[:-1]) | (x[1:] != x[:-1])]
            at, x = at[new], x[new]
            bounds = np.searchsorted(at, np.arange(width + 1))
            for f in np.flatnonzero(np.diff(bounds)).tolist():
                if f not in held or len(held[f]) <= max_bins:
                    held[f] = np.union1d(held.get(f, x[:0]), x[bounds[f]:bounds[f + 1]])[:max_bins + 1]
            for f in np.flatnonzero(stored < batch.num_rows).tolist():
                if f not in held or len(held[f]) <= max_bins:
                    held[f] = np.union1d(held.get(f, x[:0]), [0.0])
        for f, values in held.items():
            yield pa.RecordBatch.from_pydict({"at": np.full(len(values), f, np.int32), "x": values}, schema=found_schema)

    rows = df.select(F.col(features).alias("v"))
    told = rows.mapInArrow(few, "at int, x double").distinct().groupBy("at").agg(F.sort_array(F.collect_set("x")).alias("x"))
    values = {row["at"]: np.array(row["x"]) for row in told.select("at", F.slice("x", 1, max_bins + 1).alias("x")).collect()}  # one row per feature
    cuts = [(v[:-1] + v[1:]) / 2 for v in (values.get(f, np.zeros(1)) for f in range(width))]
    many = [f for f, v in values.items() if len(v) > max_bins]
    shares = [i / max_bins for i in range(1, max_bins)]
    entries = rows.select(vector_to_array("v").alias("v"))
    for first in range(0, len(many), WIDE):
        part = many[first:first + WIDE]
        for f, q in zip(part, entries.agg(*[F.percentile_approx(F.col("v")[f], shares, 100 * max_bins) for f in part]).first(), strict=True):
            cuts[f] = np.unique(np.array(q, float))
    return cuts


def _entries(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of the stored entries of vectors, sparse ones and dense ones."""
    kind = vectors.field("type").to_numpy(zero_copy_only=False)
    values = vectors.field("values")
    lengths = pc.list_value_length(values).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(vectors)), lengths)
    at = np.empty(len(row), np.int64)
    dense = np.repeat(kind == 1, lengths)
    at[dense] = np.tile(np.arange(width), int((kind == 1).sum()))
    at[~dense] = vectors.field("indices").flatten().to_numpy(zero_copy_only=False)
    return row, at, values.flatten().to_numpy(zero_copy_only=False)


def blocked(df: DataFrame, features: str, label: str, cuts: list[np.ndarray], plan: Plan, n: int) -> DataFrame:
    """The ``n`` rows in stored blocks of codes, labels and weights; rows of equal bins and label are one."""
    types, width, context = _BLOCKS, len(cuts), df.sparkSession.sparkContext
    shared = context.broadcast((cuts, plan))
    rows = df.select(F.col(features).alias("v"), F.col(label).cast("double").alias("y"))
    counted = pa.schema([("codes", pa.binary()), ("y", pa.float64()), ("w", pa.int64())])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, plan = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            row, at, x = _entries(batch.column("v"), width)
            code = np.empty(len(at), np.int32)
            order = np.argsort(at, kind="stable")
            bounds = np.searchsorted(at[order], np.arange(width + 1))
            for f in np.flatnonzero(np.diff(bounds)).tolist():
                own = order[bounds[f]:bounds[f + 1]]
                code[own] = plan.start[f] + np.searchsorted(cuts[f], x[own], side="left")
            keep = code != plan.usual[at]
            lengths = np.bincount(row[keep], minlength=batch.num_rows)
            # entries come by row and feature, so equal rows have equal bytes
            ends = np.concatenate([[0], np.cumsum(lengths) * 4]).astype(np.int32)
            each = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(code[keep]))])
            yield pa.RecordBatch.from_arrays([each, batch.column("y").cast(pa.float64()), pa.array(np.ones(batch.num_rows, np.int64))], schema=counted)

    def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, plan = shared.value
        for at, part in enumerate(_cut(batches, BLOCK_ROWS)):
            each = part.column("codes").to_pylist()
            row = {
                "block": (part.column("part")[0].as_py() << 32) + at, "rows": part.num_rows, "codes": b"".join(each),
                "lengths": np.array([len(e) // 4 for e in each], np.int32).tobytes(),
                "label": (part.column("y").to_numpy() - plan.center).tobytes(), "weight": part.column("w").to_numpy().astype(np.int64).tobytes(),
            }
            yield pa.RecordBatch.from_pylist([row], schema=types)

    tasks = max(min(context.defaultParallelism, -(-n // BLOCK_ROWS)), -(-n // TASK_ROWS), 1)
    each = rows.mapInArrow(binned, "codes binary, y double, w long").groupBy("codes", "y").agg(F.sum("w").alias("w"))
    # in an order of their own, so that a row has the same place whenever it is stored
    each = each.repartition(tasks, "codes", "y").sortWithinPartitions("codes", "y").withColumn("part", F.spark_partition_id().cast("long"))
    return shared_table(each.mapInArrow(stacked, BLOCKS), "forest")


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


class _ForestParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "probability column", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for regression", TypeConverters.toInt)
    trees = Param(Params._dummy(), "trees", "trees", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "depth of a tree", TypeConverters.toInt)
    least = Param(Params._dummy(), "least", "drawn rows that a child needs", TypeConverters.toInt)
    subset = Param(Params._dummy(), "subset", "features tried at a node: sqrt or all", TypeConverters.toString)
    maxBins = Param(Params._dummy(), "maxBins", "bins per feature", TypeConverters.toInt)
    taskCells = Param(Params._dummy(), "taskCells", "stored bins of a node that one task may hold", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(
            featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability", classes=0, trees=100, depth=30,
            least=1, subset="all", maxBins=MAX_BINS, taskCells=TASK_CELLS, seed=42,
        )

    def get(self, name: str):
        return self.getOrDefault(self.getParam(name))


class Forest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Trees on bootstrap draws: Gini impurity for classes, variance for regression."""

    def __init__(self, **params) -> None:
        super().__init__()
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> ForestModel:
        features, label = self.get("featuresCol"), self.get("labelCol")
        classes = self.get("classes")
        of_class = [F.avg((F.col(label) == k).cast("double")) for k in range(classes)]
        n, mean, *shares = dataset.agg(F.count(F.lit(1)), F.avg(label), *of_class).first()
        width = len(dataset.select(features).first()[0])
        cuts = cuts_of(dataset, features, width, self.get("maxBins"))
        start = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])]).astype(np.int64)
        usual = start[:-1] + np.array([np.searchsorted(c, 0.0, side="left") for c in cuts], np.int64)
        subset = width if self.get("subset") == "all" else int(np.ceil(np.sqrt(width)))
        plan = Plan(
            classes, start, usual, self.get("trees"), self.get("depth"), max(self.get("least"), 1), subset, self.get("seed"),
            0.0 if classes else mean, np.array(shares if classes else [mean]),
        )
        blocks = blocked(dataset, features, label, cuts, plan, n)
        different, stored = blocks.agg(F.sum("rows"), F.sum(F.octet_length("codes") / 4)).first()
        trees = forest(blocks, plan, different, stored, self.get("taskCells"))
        bounds = np.concatenate([np.append(c, np.inf) for c in cuts])
        model = ForestModel([_Scorer(plan.owner[t.cut].astype(np.int32), bounds[t.cut], t.left, t.gain, t.value) for t in trees])
        names = ("featuresCol", "predictionCol", "probabilityCol", "classes")
        return model._set(width=width, **{name: self.get(name) for name in names})


@dataclass
class _Scorer:
    """A tree with thresholds on values."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    def told(self, columns: np.ndarray) -> np.ndarray:
        """The leaf's values for each row; ``columns`` holds values by feature."""
        n = columns.shape[1]
        flat, at, active = columns.ravel(), np.zeros(n, np.intp), np.arange(n)
        while len(active):
            active = active[self.left[at[active]] >= 0]
            node = at[active]
            at[active] = self.left[node] + (flat[self.feature[node].astype(np.intp) * n + active] > self.cut[node])
        return self.value[at]


_TREES = "tree int, feature binary, cut binary, left binary, gain binary, value binary"


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession.sparkContext)
        rows = [(i, *(bytearray(getattr(t, n).tobytes()) for n in ("feature", "cut", "left", "gain", "value"))) for i, t in enumerate(self.model.grown)]
        self.sparkSession.createDataFrame(rows, _TREES).write.parquet(path + "/trees")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession.sparkContext)
        model = ForestModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        kinds = (("feature", np.int32), ("cut", float), ("left", np.int32), ("gain", float), ("value", float))
        for row in self.sparkSession.read.schema(_TREES).parquet(path + "/trees").orderBy("tree").collect():
            tree = _Scorer(*(np.frombuffer(row[name], kind) for name, kind in kinds))
            tree.value = tree.value.reshape(len(tree.left), -1)
            model.grown.append(tree)
        return model


class ForestModel(Model, _ForestParams, MLReadable, MLWritable):
    """The trees, as thresholds on values; scoring is a projection and works on a stream."""

    width = Param(Params._dummy(), "width", "entries of the vector", TypeConverters.toInt)

    def __init__(self, grown: list[_Scorer] | None = None) -> None:
        super().__init__()
        self.grown = grown or []

    def copy(self, extra=None):
        that = super().copy(extra)
        that.grown = self.grown
        return that

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()

    @property
    def numFeatures(self) -> int:
        return self.get("width")

    @property
    def getNumTrees(self) -> int:
        return len(self.grown)

    @property
    def featureImportances(self) -> DenseVector:
        """Impurity that the splits of each feature take away, as shares by tree, averaged over the trees."""
        total = np.zeros(self.get("width"))
        for tree in self.grown:
            own = np.bincount(tree.feature, tree.gain, len(total))
            total += own / own.sum() if own.sum() else 0.0
        return DenseVector(total / total.sum() if total.sum() else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        classes = self.get("classes")
        shared = dataset.sparkSession.sparkContext.broadcast(self.grown)

        @F.pandas_udf("array<double>")
        def told(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            columns = np.ascontiguousarray(np.stack(x.to_numpy()).T)
            return pd.Series(list(sum(tree.told(columns) for tree in shared.value) / len(shared.value)))

        found = told(vector_to_array(F.col(self.get("featuresCol"))))
        if not classes:
            return dataset.withColumn(self.get("predictionCol"), found[0])
        voted = dataset.withColumn("_chances", found)
        best = F.array_position("_chances", F.array_max("_chances")).cast("double") - 1
        return voted.withColumn(self.get("probabilityCol"), array_to_vector("_chances")).withColumn(self.get("predictionCol"), best).drop("_chances")
