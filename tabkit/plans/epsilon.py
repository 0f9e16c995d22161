"""Linear machines whose loss has corners, with a proof of how good the fit is.

The problem is ``|w|^2 / 2 + C sum loss(y, w x + b)`` with the epsilon-insensitive loss ``max(0, |y - f| - epsilon)`` or, for
labels -1 and 1, the hinge ``max(0, y (y - f))``. Rows are stored once in blocks as they were given; a task that sums over
them expands them first, if the machine works on more columns than the rows have, so no expanded row is ever stored or sent.
The loss is smoothed over a width that shrinks from round to round; each round is minimised by Newton steps, or by a
limited-memory quasi-Newton method beyond ``NEWTON_SIZE`` columns, whose sums over all rows are one job per evaluation. Several
problems over the same rows, as one for each class, share these jobs. The slopes of the smoothed loss are a point of the dual
problem once their positive and negative parts are brought into balance, so the same sums give a lower
bound on the least objective there is. Rounds end when the exact objective is within ``gap`` of that bound.

A table of at most ``task_cells`` numbers is fitted in one task by the same code.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.session import drop_table, shared_table

#: Rows of a block; few enough that an expanded block stays in a core's cache.
BLOCK_ROWS = 1024
TASK_CELLS = 8_000_000
MEMORY = 10
ROUNDS = 30
STEPS = 200
#: Columns up to which second derivatives are summed.
NEWTON_SIZE = 512
#: Numbers that a task sums for the problems of one job.
SUM_CELLS = 8_000_000
#: Tasks whose sums the driver adds by itself.
DIRECT_TASKS = 64
#: Vectors of at most so many entries are multiplied as whole blocks.
DENSE_WIDTH = 256


@dataclass
class Loss:
    """Errors beyond ``epsilon`` on both sides; with ``targets`` one problem for each of these labels against all
    others, by the hinge."""

    epsilon: float = 0.0
    targets: list[float] | None = None

    def labels(self, y: np.ndarray, problem: int) -> np.ndarray:
        return y if self.targets is None else np.where(y == self.targets[problem], 1.0, -1.0)

    def over(self, rest: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(rest) - self.epsilon, 0) if self.targets is None else np.maximum(y * rest, 0)


@dataclass
class Sums:
    """Over some rows: exact and smoothed loss, of the slopes' positive and negative parts their sum, their sum
    times the label and their sum times the row, and the second derivatives of the smoothed loss, if asked for."""

    exact: float
    smooth: float
    up: np.ndarray
    down: np.ndarray
    curve: np.ndarray

    def packed(self) -> np.ndarray:
        return np.concatenate([[self.exact, self.smooth], self.up, self.down, self.curve.ravel()])

    @classmethod
    def unpacked(cls, values: np.ndarray, size: int) -> Sums:
        ends = 2 + (size + 2), 2 + 2 * (size + 2)
        curve = values[ends[1]:]
        return cls(float(values[0]), float(values[1]), values[2:ends[0]], values[ends[0]:ends[1]], curve.reshape(size + 1, -1) if len(curve) else curve)


def sums_of(x: np.ndarray, y: np.ndarray, weights: np.ndarray, loss: Loss, width: float) -> Sums:
    rest = y - x @ weights[:-1] - weights[-1]
    over = loss.over(rest, y)
    smooth = np.where(over < width, over * over / (2 * width), over - width / 2)
    slope = np.minimum(over / width, 1) * np.sign(rest)
    parts = []
    for side in (np.maximum(slope, 0), np.maximum(-slope, 0)):
        parts.append(np.concatenate([[side.sum(), side @ y], side @ x]))
    curve = np.zeros(0)
    if x.shape[1] <= NEWTON_SIZE:
        bent = x[(over > 0) & (over < width)]
        curve, total = np.empty((x.shape[1] + 1,) * 2), bent.sum(axis=0)
        curve[:-1, :-1], curve[-1, :-1], curve[:-1, -1], curve[-1, -1] = bent.T @ bent, total, total, len(bent)
        curve /= width
    return Sums(float(over.sum()), float(smooth.sum()), *parts, curve)


Asking = Generator[tuple[np.ndarray, float], Sums, tuple]
Gather = Callable[[dict[int, tuple[np.ndarray, float]]], dict[int, Sums]]


@dataclass
class Problem:
    """What is asked for by ``yield`` are sums over all rows at some weights and width."""

    size: int
    c: float
    loss: Loss

    def smoothed(self, weights: np.ndarray, width: float) -> Asking:
        """Value and gradient of the smoothed objective."""
        sums = yield weights, width
        w = weights[:-1]
        force = sums.up - sums.down
        return w @ w / 2 + self.c * sums.smooth, np.append(w - self.c * force[2:], -self.c * force[0]), sums

    def objective(self, weights: np.ndarray, sums: Sums) -> float:
        return float(weights[:-1] @ weights[:-1] / 2 + self.c * sums.exact)

    def bound(self, sums: Sums) -> float:
        """The dual objective at the slopes, with the larger side scaled down to the smaller."""
        up, down = sums.up * self.c, sums.down * self.c
        if up[0] > down[0]:
            up = up * (down[0] / up[0])
        elif down[0] > 0:
            down = down * (up[0] / down[0])
        force = up - down
        return float(force[1] - self.loss.epsilon * (up[0] + down[0]) - force[2:] @ force[2:] / 2)


@dataclass
class Reached:
    """The best weights so far, their exact objective, and a lower bound on every objective."""

    problem: Problem
    weights: np.ndarray
    gap: float
    spread: float
    best: float = np.inf
    bound: float = -np.inf

    def note(self, weights: np.ndarray, sums: Sums) -> None:
        value = self.problem.objective(weights, sums)
        if value < self.best:
            self.best, self.weights = value, weights
        self.bound = max(self.bound, self.problem.bound(sums))

    @property
    def near(self) -> bool:
        return self.best - self.bound <= self.gap * max(abs(self.best), 1e-12 * self.spread)


def minimised(problem: Problem, weights: np.ndarray, width: float, gap: float, spread: float) -> Asking:
    """The weights, their exact objective and a lower bound on every objective."""
    reached = Reached(problem, weights, gap, spread)
    step = _newton if problem.size <= NEWTON_SIZE else _descended
    for _ in range(ROUNDS):
        weights = yield from step(problem, weights, width, reached)
        if reached.near:
            break
        width /= 4
    return reached.weights, reached.best, reached.bound


def _newton(problem: Problem, weights: np.ndarray, width: float, reached: Reached) -> Asking:
    """Newton steps with a backtracking search, until the slope that is left hardly lowers the bound."""
    value, slope, sums = yield from problem.smoothed(weights, width)
    reached.note(weights, sums)
    own = np.arange(problem.size)
    for _ in range(STEPS):
        left = np.linalg.norm(slope[:-1]) + 1.5 * abs(slope[-1])
        if reached.near or left * (np.linalg.norm(weights[:-1]) + left / 2 + 1) <= 0.1 * reached.gap * abs(reached.best):
            break
        curve = problem.c * sums.curve
        curve[own, own] += 1
        # the offset has no penalty; where no row bends the loss it still needs a finite step
        curve[-1, -1] += 1e-9 * problem.c * (sums.up[0] + sums.down[0]) / width + 1e-12
        way = -np.linalg.solve(curve, slope)
        fall, length = slope @ way, 1.0
        if not fall < 0:
            break
        for _ in range(40):
            new_value, new_slope, new_sums = yield from problem.smoothed(weights + length * way, width)
            reached.note(weights + length * way, new_sums)
            if new_value <= value + 1e-4 * length * fall + 1e-13 * abs(value):
                break
            # the least of the parabola through both values and the slope
            length *= min(max(-fall * length / (2 * (new_value - value - fall * length)), 0.1), 0.5)
        else:
            break
        weights, value, slope, sums = weights + length * way, new_value, new_slope, new_sums
    return weights


def _descended(problem: Problem, weights: np.ndarray, width: float, reached: Reached) -> Asking:
    """Limited-memory quasi-Newton steps with a backtracking search."""
    value, slope, sums = yield from problem.smoothed(weights, width)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        norm = np.abs(slope).max()
        if norm <= 1e-7 * max(1.0, problem.c * (sums.up[0] + sums.down[0])):
            break
        way, kept = -slope, []
        for s, g in reversed(moves):
            share = s @ way / (s @ g)
            kept.append(share)
            way = way - share * g
        if moves:
            s, g = moves[-1]
            way = way * (s @ g / (g @ g))
        else:
            way = way / max(np.linalg.norm(slope), 1e-300) * min(1.0, np.linalg.norm(slope))
        for (s, g), share in zip(moves, reversed(kept), strict=True):
            way = way + s * (share - g @ way / (s @ g))
        fall, step = slope @ way, 1.0
        if fall >= 0:
            way, fall, moves = -slope, -(slope @ slope), []
        for _ in range(40):
            new_value, new_slope, new_sums = yield from problem.smoothed(weights + step * way, width)
            if new_value <= value + 1e-4 * step * fall:
                break
            step /= 2
        else:
            break
        s, g = step * way, new_slope - slope
        if s @ g > 1e-12 * np.sqrt((s @ s) * (g @ g)):
            moves = [*moves, (s, g)][-MEMORY:]
        done = value - new_value <= 1e-10 * max(abs(value), 1.0)
        weights, value, slope, sums = weights + s, new_value, new_slope, new_sums
        if done:
            break
    reached.note(weights, sums)
    return weights


def solved(problems: list[Asking], gather: Gather) -> list[tuple[np.ndarray, float, float]]:
    """The answers of all problems; what they ask for at the same time is gathered together."""
    answers: list = [None] * len(problems)
    asked = {k: next(problem) for k, problem in enumerate(problems)}
    while asked:
        found, asked = gather(asked), {}
        for k, sums in found.items():
            try:
                asked[k] = problems[k].send(sums)
            except StopIteration as end:
                answers[k] = end.value
    return answers


BLOCKS = "rows int, slots int, at binary, x binary, y binary"
_BLOCKS = pa.schema([("rows", pa.int32()), ("slots", pa.int32()), ("at", pa.binary()), ("x", pa.binary()), ("y", pa.binary())])


def _blocked(df: DataFrame, features: str, label: str) -> DataFrame:
    """Blocks of rows: all entries of vectors, or, where vectors leave most entries out, those given with their places."""
    rows = df.select(F.unwrap_udt(features).alias("v"), F.col(label).cast("double").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                at, x = _entries(part.column("v"))
                y = part.column("y").to_numpy(zero_copy_only=False)
                row = {"rows": part.num_rows, "slots": x.shape[1], "at": None if at is None else at.tobytes(), "x": x.tobytes(), "y": y.tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=_BLOCKS)

    return shared_table(rows.mapInArrow(run, BLOCKS), "epsilon")


def _entries(vectors: pa.StructArray) -> tuple[np.ndarray | None, np.ndarray]:
    """Places and entries by row; no places if the entries are all there are."""
    kind, size, places, entries = vectors.flatten()
    dense = kind.to_numpy(zero_copy_only=False) == 1
    lengths = entries.value_lengths().to_numpy(zero_copy_only=False)
    width = int(lengths[dense][0]) if dense.any() else int(size[0].as_py())
    slots = int(lengths.max(initial=0))
    row = np.repeat(np.arange(len(vectors)), lengths)
    slot = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = slot.copy()
    place[~dense[row]] = places.flatten().to_numpy(zero_copy_only=False)
    values = entries.flatten().to_numpy(zero_copy_only=False)
    if 2 * slots >= width:
        x = np.zeros((len(vectors), width))
        x[row, place] = values
        return None, x
    at, x = np.zeros((len(vectors), slots), np.int32), np.zeros((len(vectors), slots))
    at[row, slot], x[row, slot] = place, values
    return at, x


@dataclass
class Waves:
    """Random cosines whose inner products approximate the RBF kernel ``exp(-gamma |x - y|^2)``."""

    directions: np.ndarray
    shifts: np.ndarray

    @classmethod
    def drawn(cls, gamma: float, width: int, components: int, seed: int) -> Waves:
        rng = np.random.default_rng(seed)
        directions = rng.normal(0.0, np.sqrt(2 * gamma), (width, components))
        return cls(directions, rng.uniform(0, 2 * np.pi, components))

    def of(self, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The cosines of whole rows, or of the entries at some places."""
        width, components = self.directions.shape
        if at is None:
            z = x @ self.directions
        elif width <= DENSE_WIDTH:
            z = _whole(x, at, width) @ self.directions
        else:
            z = np.zeros((len(x), components))
            for slot in range(x.shape[1]):
                z += x[:, slot, None] * self.directions[at[:, slot]]
        z += self.shifts
        _cosines(z)
        z *= np.sqrt(2.0 / components)
        return z


#: Coefficients of the sine of a share of a turn, up to a quarter of it, to about 1e-13.
_SINE = [(-1) ** k * (2 * math.pi) ** (2 * k + 1) / math.factorial(2 * k + 1) for k in range(9)]


def _cosines(z: np.ndarray) -> None:
    """Replace angles by their cosines; numpy's own function takes most of the time of a pass."""
    for start in range(0, len(z), 512):
        part = z[start:start + 512]
        part *= 1 / (2 * math.pi)
        part -= np.rint(part)
        np.subtract(0.25, np.abs(part), out=part)
        square, value = part * part, np.full_like(part, _SINE[-1])
        for coefficient in reversed(_SINE[:-1]):
            value *= square
            value += coefficient
        part *= value


def _whole(x: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Rows with all their entries; unused slots add zero to the first."""
    whole, rows = np.zeros((len(x), width)), np.arange(len(x))
    for slot in range(x.shape[1]):
        whole[rows, at[:, slot]] += x[:, slot]
    return whole


def _read(row: dict, width: int, waves: Waves | None) -> tuple[np.ndarray, np.ndarray]:
    """A block's expanded rows and labels."""
    x, y = np.frombuffer(row["x"]).reshape(row["rows"], row["slots"]), np.frombuffer(row["y"])
    at = None if row["at"] is None else np.frombuffer(row["at"], np.int32).reshape(x.shape)
    if waves is not None:
        return waves.of(x, at), y
    return (x if at is None else _whole(x, at, width)), y


def _added(parts: DataFrame) -> DataFrame:
    """The sum of all rows of numbers in each partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for sums in batch.column("sums").to_pylist():
                total = np.frombuffer(sums) if total is None else total + np.frombuffer(sums)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]}, schema=_SUMS)

    return parts.mapInArrow(run, "sums binary")


_SUMS = pa.schema([("sums", pa.binary())])


def _spread_out(blocks: DataFrame, width: int, waves: Waves | None, loss: Loss) -> Gather:
    """Sums over stored blocks: each task sends one row of numbers."""
    context = blocks.sparkSession.sparkContext
    size = width if waves is None else len(waves.shifts)
    tasks = blocks.rdd.getNumPartitions()

    def job(asked: dict[int, tuple[np.ndarray, float]]) -> dict[int, Sums]:
        shared = context.broadcast((asked, waves, loss))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, waves, loss = shared.value
            total = None
            for batch in batches:
                for row in batch.to_pylist():
                    x, y = _read(row, width, waves)
                    found = np.concatenate([sums_of(x, loss.labels(y, k), w, loss, wide).packed() for k, (w, wide) in asked.items()])
                    total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]}, schema=_SUMS)

        parts = blocks.mapInArrow(run, "sums binary")
        if tasks > DIRECT_TASKS:
            parts = _added(parts.repartition(math.isqrt(tasks)))
        total = np.sum([np.frombuffer(r["sums"]) for r in parts.collect()], axis=0)
        shared.unpersist()
        return {k: Sums.unpacked(part, size) for k, part in zip(asked, np.split(total, len(asked)), strict=True)}

    def gather(asked: dict[int, tuple[np.ndarray, float]]) -> dict[int, Sums]:
        room, every = max(SUM_CELLS // (size + 1) ** 2, 1), list(asked)
        return {k: s for i in range(0, len(every), room) for k, s in job({k: asked[k] for k in every[i:i + room]}).items()}

    return gather


@dataclass
class Start:
    """Where a problem begins: offset, width of the smoothing, and the size of the labels."""

    offset: float
    width: float
    spread: float


def fitted(
    dataset: DataFrame, features: str, label: str, starts: list[Start], c: float, loss: Loss, gap: float, task_cells: int,
    n: int, waves: Waves | None = None,
) -> list[tuple[np.ndarray, float, float]]:
    """Weights with the offset, objective and bound of every problem over the ``n`` rows."""
    width = len(dataset.select(features).first()[0])
    size = width if waves is None else len(waves.shifts)
    blocks = _blocked(dataset, features, label)

    def problems() -> list[Asking]:
        return [minimised(Problem(size, c, loss), np.append(np.zeros(size), s.offset), s.width, gap, s.spread) for s in starts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_read(row, width, waves) for batch in batches for row in batch.to_pylist()]
        x, y = np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
        gather = lambda asked: {k: sums_of(x, loss.labels(y, k), w, loss, wide) for k, (w, wide) in asked.items()}
        for weights, best, bound in solved(problems(), gather):
            yield pa.RecordBatch.from_pydict({"fit": [json.dumps([weights.tolist(), best, bound])]})

    try:
        if n * size <= task_cells:
            told = [json.loads(r["fit"]) for r in blocks.repartition(1).mapInArrow(run, "fit string").collect()]
            return [(np.array(weights), best, bound) for weights, best, bound in told]
        return solved(problems(), _spread_out(blocks, width, waves, loss))
    finally:
        drop_table(blocks)


class _EpsilonParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column", TypeConverters.toString)
    C = Param(Params._dummy(), "C", "inverse penalty", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "error that costs nothing", TypeConverters.toFloat)
    gap = Param(Params._dummy(), "gap", "relative distance to the least objective", TypeConverters.toFloat)
    taskCells = Param(Params._dummy(), "taskCells", "numbers that one task may fit", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(
            featuresCol="features", labelCol="label", predictionCol="prediction", C=1.0, epsilon=0.1, gap=1e-3, taskCells=TASK_CELLS
        )

    def get(self, name: str):
        return self.getOrDefault(self.getParam(name))


class EpsilonRegression(Estimator, _EpsilonParams, DefaultParamsReadable, DefaultParamsWritable):
    """Regression that ignores errors up to ``epsilon``."""

    def __init__(self, **params) -> None:
        super().__init__()
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> EpsilonModel:
        features, label, epsilon = self.get("featuresCol"), self.get("labelCol"), self.get("epsilon")
        n, mean, deviation, total = dataset.agg(
            F.count(F.lit(1)), F.avg(label), F.stddev_pop(label), F.sum(F.abs(F.col(label).cast("double")))
        ).first()
        start = Start(mean or 0.0, max(deviation or 0.0, 1e-6), total or 0.0)
        (weights, best, bound), = fitted(dataset, features, label, [start], self.get("C"), Loss(epsilon), self.get("gap"), self.get("taskCells"), n)
        model = EpsilonModel()
        model._set(**{n: self.get(n) for n in ("featuresCol", "predictionCol", "C", "epsilon")})
        return model._set(weights=weights[:-1].tolist(), offset=float(weights[-1]), objective=float(best), bound=float(bound))


class EpsilonModel(Model, _EpsilonParams, DefaultParamsReadable, DefaultParamsWritable):
    """Weights and offset, with the objective that they reach and a bound that none falls below."""

    weights = Param(Params._dummy(), "weights", "weights", TypeConverters.toListFloat)
    offset = Param(Params._dummy(), "offset", "offset", TypeConverters.toFloat)
    objective = Param(Params._dummy(), "objective", "objective of the fit", TypeConverters.toFloat)
    bound = Param(Params._dummy(), "bound", "lower bound of the objective", TypeConverters.toFloat)

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(self.get("weights"))

    @property
    def intercept(self) -> float:
        return self.get("offset")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(float(w)) for w in self.get("weights")])
        products = F.zip_with(vector_to_array(F.col(self.get("featuresCol"))), weights, lambda a, b: a * b)
        return dataset.withColumn(self.get("predictionCol"), F.aggregate(products, F.lit(self.get("offset")), lambda a, x: a + x))
