"""Support vector machines with a Gaussian kernel, exact, by a cascade.

The dual problem is solved on parts of the rows; what each part keeps is its support vectors. Parts are merged four by
four and solved again, from the multipliers that they have, until one set is left. A part that two multipliers at a time do
not settle soon is solved by an interior point, where its kernel matrix is near one of low rank. Equal rows of a class are one row
whose multiplier may be as many times as large. Then all rows are held against the machine: rows that break an optimality
condition, the worst ``VIOLATORS`` first, join the set, which is solved again, until no row breaks one. Every round
raises the dual objective, so the rounds end, and they end at the solution for all rows. Several classes are a
machine for every pair of classes, whose votes elect the class, the lower one on ties.

A set of support vectors is what one task must hold; it grows with the rows that the classes dispute, so it is limited
to ``max_support`` rows per pair, and a wider dispute is refused with a message: ``method="fourier"`` has no limit.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.session import shared_table

PART_ROWS = 1500
FAN_IN = 4
VIOLATORS = 500
MAX_SUPPORT = 20_000
TOLERANCE = 1e-3
ROUNDS = 200
#: Tasks over which the parts of a level are spread.
MOST_TASKS = 256
#: Rows whose whole kernel matrix is kept.
MATRIX_ROWS = 4000
#: Steps of two multipliers before an interior point is looked for; columns and cells of the factor that it needs, at most.
FIRST_STEPS = 2000
FACTOR_COLUMNS = 600
FACTOR_CELLS = 1 << 23
SOLVED = "problem int, part long, id long, y double, vec array<double>, w long, alpha double, offset double"


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    squares = np.add.outer((a * a).sum(axis=1), (b * b).sum(axis=1))
    squares -= 2 * a @ b.T
    np.maximum(squares, 0, out=squares)
    squares *= -gamma
    return np.exp(squares, out=squares)


def factor(x: np.ndarray, gamma: float, most: int, left_over: float = 1e-9) -> np.ndarray | None:
    """Columns whose products with each other are the kernel matrix up to ``left_over`` (a pivoted Cholesky factor); None if
    ``most`` columns are too few. Few are enough if rows lie close together for the kernel."""
    n = len(x)
    left, columns = np.ones(n), np.empty((min(n, most, 64), n))
    for r in range(min(n, most)):
        at = int(left.argmax())
        if left[at] <= left_over:
            return columns[:r].T
        if r == len(columns):
            columns = np.concatenate([columns, np.empty_like(columns)])
        columns[r] = (kernel(x[at:at + 1], x, gamma)[0] - columns[:r, at] @ columns[:r]) / np.sqrt(left[at])
        left -= columns[r] * columns[r]
        left[at] = 0
    return columns[:min(n, most)].T if left.max() <= left_over else None


def interior(half: np.ndarray, y: np.ndarray, c: np.ndarray, gap: float = 1e-8, steps: int = 80) -> np.ndarray | None:
    """Multipliers of the dual problem by an interior-point method (Mehrotra's steps) over a ``factor`` of the kernel matrix:
    a step costs rows times columns squared, and the number of steps hardly depends on the rows or on ``c``."""
    half = half * y[:, None]
    both = [c[y > 0].sum(), c[y < 0].sum()]
    alpha = 0.1 * c * np.where(y > 0, min(both) / both[0], min(both) / both[1])
    room, lower, upper, offset = c - alpha, np.ones(len(y)), np.ones(len(y)), 0.0
    longest = lambda v, dv: min(1.0, (-v[dv < 0] / dv[dv < 0]).min(initial=1.0))
    for _ in range(steps):
        short = half @ (half.T @ alpha) - 1 + offset * y - lower + upper
        if np.abs(short).max() < 1e-5 and max((lower * alpha / c).max(), (upper * room / c).max()) < gap:
            break
        weight = lower / alpha + upper / room
        light = half / weight[:, None]
        try:
            small = np.linalg.inv(np.linalg.cholesky(np.eye(half.shape[1]) + half.T @ light))
        except np.linalg.LinAlgError:  # as near as the digits allow
            break
        inverse = lambda v: v / weight - light @ (small.T @ (small @ (light.T @ v)))  # noqa: B023, E731
        across = inverse(y)

        def step(low, high):
            d = inverse(low / alpha - high / room - lower + upper - short)  # noqa: B023
            shift = (y @ d + y @ alpha) / (y @ across)  # noqa: B023
            d = d - shift * across  # noqa: B023
            return d, shift, (low - lower * d) / alpha - lower, (high + upper * d) / room - upper  # noqa: B023

        mean = (lower @ alpha + upper @ room) / (2 * len(y))
        d, _, dl, du = step(0.0, 0.0)
        p, q = min(longest(alpha, d), longest(room, -d)), min(longest(lower, dl), longest(upper, du))
        ahead = ((alpha + p * d) @ (lower + q * dl) + (room - p * d) @ (upper + q * du)) / (2 * len(y))
        aim = (ahead / mean) ** 3 * mean
        d, shift, dl, du = step(aim - d * dl, aim + d * du)
        size = 0.995 * min(longest(alpha, d), longest(room, -d), longest(lower, dl), longest(upper, du))
        alpha, room, offset = alpha + size * d, room - size * d, offset + size * shift  # a difference of c would round to 0
        lower, upper = lower + size * dl, upper + size * du
    if not np.isfinite(alpha).all():
        return None
    alpha = np.where(alpha < 1e-6 * c, 0.0, np.where(alpha > c * (1 - 1e-6), c, alpha))
    over = float(y @ alpha)
    mine = np.flatnonzero((y * over > 0) & (alpha > 0))
    mine = mine[np.argsort(alpha[mine] >= c[mine], kind="stable")]  # those at the bound stay there if they can
    cut = np.minimum(alpha[mine], np.maximum(abs(over) - (np.cumsum(alpha[mine]) - alpha[mine]), 0))
    alpha[mine] -= cut
    return alpha


def solve(x: np.ndarray, y: np.ndarray, c: float | np.ndarray, gamma: float, alpha: np.ndarray | None = None, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Multipliers and offset of the dual problem, two multipliers at a time: the one that breaks the conditions most,
    and the one that then gains most. Wide boxes take very many such steps: if a few thousand are not enough and the kernel
    matrix has a thin ``factor``, they go on from the ``interior`` solution. ``c`` bounds all multipliers or each of them,
    ``alpha`` is a feasible start."""
    n = len(y)
    c = np.broadcast_to(np.asarray(c, float), n)
    matrix = kernel(x, x, gamma) if n <= MATRIX_ROWS else None
    rows: dict[int, np.ndarray] = {}

    def row(i: int) -> np.ndarray:
        if matrix is not None:
            return matrix[i]
        if i not in rows:
            if len(rows) >= MATRIX_ROWS:
                rows.pop(next(iter(rows)))
            rows[i] = kernel(x[i:i + 1], x, gamma)[0]
        return rows[i]

    def slopes(alpha: np.ndarray) -> np.ndarray:
        slope = -np.ones(n)
        held = np.flatnonzero(alpha)
        for start in range(0, len(held), 256):
            some = held[start:start + 256]
            slope += y * ((matrix[:, some] if matrix is not None else kernel(x, x[some], gamma)) @ (y[some] * alpha[some]))
        return slope

    def settled(steps: int) -> bool:
        nonlocal slope
        for _ in range(steps):
            force = -y * slope
            up = (alpha < c) & (y > 0) | (alpha > 0) & (y < 0)
            down = (alpha < c) & (y < 0) | (alpha > 0) & (y > 0)
            if not up.any() or not down.any():
                return True
            i = int(np.where(up, force, -np.inf).argmax())
            low = np.where(down, force, np.inf)
            if force[i] - low.min() < tolerance:
                return True
            here = row(i)
            apart = force[i] - low
            bend = np.maximum(2 - 2 * here, 1e-12)
            j = int(np.where(apart > 0, apart * apart / bend, -np.inf).argmax())
            there = row(j)
            step = (force[i] - force[j]) / max(2 - 2 * here[j], 1e-12)
            # y_i alpha_i grows and y_j alpha_j falls by the step, as far as the box allows
            step = min(step, c[i] - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else c[j] - alpha[j])
            alpha[i] += y[i] * step
            alpha[j] -= y[j] * step
            for k in (i, j):
                alpha[k] = 0.0 if alpha[k] < 1e-12 * c[k] else c[k] if alpha[k] > c[k] * (1 - 1e-12) else alpha[k]
            slope += step * y * (here - there)
        return False

    alpha = np.zeros(n) if alpha is None else alpha.copy()
    slope = slopes(alpha)
    if not settled(FIRST_STEPS):
        half = factor(x, gamma, min(FACTOR_COLUMNS, FACTOR_CELLS // n))
        other = interior(half, y, c) if half is not None else None
        if other is not None:
            steep = slopes(other)
            if other @ steep - other.sum() < alpha @ slope - alpha.sum():  # twice the dual objective
                alpha, slope = other, steep
        settled(200 * n + 10_000)
    force = -y * slope
    free = (alpha > 0) & (alpha < c)
    if free.any():
        return alpha, float(force[free].mean())
    up = (alpha < c) & (y > 0) | (alpha > 0) & (y < 0)
    down = (alpha < c) & (y < 0) | (alpha > 0) & (y > 0)
    ends = [v for v in (force[up].max() if up.any() else None, force[down].min() if down.any() else None) if v is not None]
    return alpha, float(np.mean(ends)) if ends else 0.0


class _KernelParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction column", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    C = Param(Params._dummy(), "C", "inverse penalty", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    partRows = Param(Params._dummy(), "partRows", "rows of a first part", TypeConverters.toInt)
    maxSupport = Param(Params._dummy(), "maxSupport", "support vectors per pair of classes", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(
            featuresCol="features", labelCol="label", predictionCol="prediction", classes=2, C=1.0, gamma=1.0, partRows=PART_ROWS, maxSupport=MAX_SUPPORT
        )

    def get(self, name: str):
        return self.getOrDefault(self.getParam(name))


def pairs(classes: int) -> list[tuple[int, int]]:
    return list(itertools.combinations(range(classes), 2))


class KernelMachine(Estimator, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    """The exact machine, by a cascade over parts of the rows."""

    def __init__(self, **params) -> None:
        super().__init__()
        self._set(**params)

    def _fit(self, dataset: DataFrame) -> KernelModel:
        rows = self._rows(dataset)
        counts = {r["problem"]: r["n"] for r in rows.groupBy("problem").agg(F.count(F.lit(1)).alias("n")).collect()}
        parts = F.lit(1)
        for problem, n in counts.items():
            parts = F.when(F.col("problem") == problem, -(-n // self.get("partRows"))).otherwise(parts)
        blank = (F.lit(0.0).alias("alpha"), F.lit(0.0).alias("offset"))
        level = rows.select("problem", F.pmod(F.xxhash64("id", F.lit(7)), parts).cast("long").alias("part"), "id", "y", "vec", "w", *blank)
        level = shared_table(self._solved(level), "cascade")
        while level.agg(F.max("part")).first()[0] or 0:
            merged = level.withColumn("part", F.floor(F.col("part") / FAN_IN))
            self._bounded(merged)
            level = shared_table(self._solved(merged), "cascade")
        for _ in range(ROUNDS):
            model = self._model(level, counts)
            # as many again as are in the set, so that rounds do not grow with it, while there is room
            held = max(r["count"] for r in level.groupBy("problem").count().collect())
            worst = model.broken(rows, level, max(VIOLATORS, min(held, self.get("maxSupport") - held)))
            if worst is None:
                return model
            joined = level.unionByName(worst.select("problem", F.lit(0).cast("long").alias("part"), "id", "y", "vec", "w", *blank))
            self._bounded(joined)
            level = shared_table(self._solved(joined), "cascade")
        raise ValueError(f"the cascade did not settle in {ROUNDS} rounds")

    def _rows(self, dataset: DataFrame) -> DataFrame:
        """(problem, id, y, vec, w): every different row once for each pair of classes that it belongs to, with the number
        of its copies. Rows are numbered in a stored table."""
        label, every = F.col("label").cast("int"), pairs(self.get("classes"))
        numbered = shared_table(
            dataset.select(vector_to_array(F.col(self.get("featuresCol"))).alias("vec"), F.col(self.get("labelCol")).alias("label"))
            .groupBy("vec", "label").agg(F.count(F.lit(1)).alias("w")).withColumn("id", F.monotonically_increasing_id()), "cascade-rows",
        )
        entry = lambda i, a, b: F.when(label.isin(a, b), F.struct(F.lit(i).alias("problem"), F.when(label == b, 1.0).otherwise(-1.0).alias("y")))
        mine = F.filter(F.array(*[entry(i, a, b) for i, (a, b) in enumerate(every)]), lambda e: e.isNotNull())
        return numbered.select("id", "vec", "w", F.explode(mine).alias("e")).select("e.problem", "id", "e.y", "vec", "w")

    def _bounded(self, level: DataFrame) -> None:
        most = level.groupBy("problem", "part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most > self.get("maxSupport"):
            raise ValueError(f"{most} support vectors, more than {self.get('maxSupport')}: use method='fourier' or raise max_support")

    def _solved(self, level: DataFrame) -> DataFrame:
        """The support vectors of every part, with their multipliers and the offset."""
        c, gamma = self.get("C"), self.get("gamma")

        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("id", ignore_index=True).drop_duplicates("id")
            x, y = np.stack(part["vec"].to_numpy()), part["y"].to_numpy()
            alpha, offset = solve(x, y, c * part["w"].to_numpy(), gamma, part["alpha"].to_numpy())
            # a part of one class has no support vectors: its first row stands for it
            kept = alpha > 0 if (alpha > 0).any() else np.arange(len(y)) == 0
            return part.assign(alpha=alpha, offset=offset)[kept]

        names = [f.split()[0] for f in SOLVED.split(", ")]
        # by number: small parts that take long would else be put together into few tasks
        parts = level.select("problem", "part").distinct().count()
        spread = level.select(*names).repartition(max(min(parts, MOST_TASKS), 1), "problem", "part")
        return spread.groupBy("problem", "part").applyInPandas(run, SOLVED)

    def _model(self, level: DataFrame, counts: dict[int, int]) -> KernelModel:
        found = level.orderBy("problem", "id").toPandas()  # at most max_support rows per pair
        machines = []
        for problem in range(len(pairs(self.get("classes")))):
            own = found[found["problem"] == problem]
            machines.append({
                "vectors": [list(map(float, v)) for v in own["vec"]], "weights": (own["alpha"] * own["y"]).tolist(),
                "offset": float(own["offset"].iloc[0]) if len(own) else 0.0,
            })
        model = KernelModel()
        return model._set(machines=json.dumps(machines), **{n: self.get(n) for n in ("featuresCol", "predictionCol", "classes", "C", "gamma")})


class KernelModel(Model, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Support vectors, weights and offset for every pair of classes."""

    machines = Param(Params._dummy(), "machines", "a machine per pair of classes", TypeConverters.toString)

    def _machines(self) -> list[tuple[np.ndarray, np.ndarray, float]]:
        return [(np.array(m["vectors"]), np.array(m["weights"]), m["offset"]) for m in json.loads(self.get("machines"))]

    @property
    def support(self) -> int:
        return sum(len(m["weights"]) for m in json.loads(self.get("machines")))

    def broken(self, rows: DataFrame, level: DataFrame, most: int) -> DataFrame | None:
        """Of rows (problem, id, y, vec) those outside the set ``level`` that break a condition, the worst of each
        problem; None if there are none. The set is broadcast: it has ``max_support`` rows per problem at most."""
        shared, gamma = rows.sparkSession.sparkContext.broadcast(self._machines()), self.get("gamma")

        @F.pandas_udf("double")
        def margin(problem: pd.Series, y: pd.Series, vec: pd.Series) -> pd.Series:
            out = np.zeros(len(y))
            for number in np.unique(problem):
                here = np.flatnonzero(problem.to_numpy() == number)
                out[here] = _decided(np.stack(vec.to_numpy()[here]), shared.value[number], gamma) * y.to_numpy()[here]
            return pd.Series(out)

        short = rows.withColumn("margin", margin("problem", "y", "vec")).filter(F.col("margin") < 1 - 2 * TOLERANCE)
        short = shared_table(short.join(F.broadcast(level.select("problem", "id")), ["problem", "id"], "left_anti"), "cascade-broken")
        if short.isEmpty():
            return None
        parts = [short.filter(F.col("problem") == i).orderBy("margin", "id").limit(most) for i in range(len(shared.value))]
        worst = parts[0]
        for part in parts[1:]:
            worst = worst.union(part)
        return worst

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared, gamma, classes = dataset.sparkSession.sparkContext.broadcast(self._machines()), self.get("gamma"), self.get("classes")

        @F.pandas_udf("double")
        def elected(vec: pd.Series) -> pd.Series:
            if not len(vec):
                return pd.Series([], dtype=float)
            x, votes = np.stack(vec.to_numpy()), np.zeros((len(vec), classes))
            for machine, (a, b) in zip(shared.value, pairs(classes), strict=True):
                won = _decided(x, machine, gamma) > 0
                votes[:, b] += won
                votes[:, a] += ~won
            return pd.Series(votes.argmax(axis=1).astype(float))

        return dataset.withColumn(self.get("predictionCol"), elected(vector_to_array(F.col(self.get("featuresCol")))))


def _decided(x: np.ndarray, machine: tuple[np.ndarray, np.ndarray, float], gamma: float) -> np.ndarray:
    """The machine's value for each row, in slices of bounded size."""
    vectors, weights, offset = machine
    out = np.full(len(x), offset)
    if len(weights):
        step = max((1 << 17) // len(weights), 1)  # a slice stays in a core's cache
        for start in range(0, len(x), step):
            out[start:start + step] += kernel(x[start:start + step], vectors, gamma) @ weights
    return out

