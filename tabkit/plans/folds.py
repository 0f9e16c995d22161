"""Feature pipelines of all folds from the same few passes.

The training rows of a fold are all rows of the other folds. So every statistic of every fold follows from counts, means,
deviations and value counts kept by fold: moments of the other folds are merged, counts of a fold are taken from the
counts of all. Order statistics need the values near a rank: a sketch over all rows proposes cut points, one pass counts
rows per interval and fold, one fetches the few rows in the intervals that hold some fold's rank. Four passes serve any
number of folds; where too many rows lie near the ranks, the median of that fold is found by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.functions.kinds import col
from tabkit.functions.quantiles import ACCURACY, RANKED_ROWS, _margin, _places, quantiles
from tabkit.functions.stats import finite_or_null
from tabkit.plans.features import TablePrep, TablePrepModel

#: Rows around the median that are fetched for a fold, as a share.
SPREAD = 4


def merged_moments(parts: Sequence[tuple[int, float, float]]) -> tuple[int, float, float]:
    """(rows, mean, population variance) of several groups together."""
    n, mean, square = 0, 0.0, 0.0
    for m, other, variance in parts:
        if m:
            apart, whole = other - mean, n + m
            square += variance * m + apart * apart * n * m / whole
            mean, n = mean + apart * m / whole, whole
    return n, mean, square / n if n else 0.0


class _Numbers:
    """Moments and medians of numeric columns for the rows outside each fold."""

    def __init__(self, data: DataFrame, columns: int, k: int) -> None:
        self.data, self.columns, self.k = data, columns, k
        names = [f"c{i}" for i in range(columns)]
        facts = [f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.count, F.avg, F.var_pop)]
        rows = data.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), *facts).collect()  # one row per fold
        self.rows = [0] * k
        self.parts = [[(0, 0.0, 0.0)] * columns for _ in range(k)]
        for r in rows:
            self.rows[r["fold"]] = r["rows"]
            self.parts[r["fold"]] = [(r[f"count_{c}"], r[f"avg_{c}"] or 0.0, r[f"var_pop_{c}"] or 0.0) for c in names]

    def outside(self, fold: int, column: int) -> list[tuple[int, float, float]]:
        return [self.parts[f][column] for f in range(self.k) if f != fold]

    def medians(self, ranked_rows: int) -> list[list[float | None]]:
        """By fold and column; ``None`` where a column has no value outside the fold."""
        sizes = np.array([[sum(n for n, _, _ in self.outside(f, i)) for i in range(self.columns)] for f in range(self.k)])
        out: list[list[float | None]] = [[None] * self.columns for _ in range(self.k)]
        if not self.columns or not sizes.any():
            return out
        edges = self._edges(int(sizes.max()))
        counts = self._counts(edges)
        wanted = {(f, i): sorted({(n - 1) // 2, n // 2}) for f in range(self.k) for i, n in enumerate(sizes[f]) if n}
        places: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
        needed: dict[int, set[int]] = {}
        for (f, i), ranks in wanted.items():
            outside = np.cumsum(counts[i].sum(axis=1) - counts[i][:, f])
            for rank in ranks:
                b = int(np.searchsorted(outside, rank, side="right"))
                places.setdefault((f, i), {})[rank] = b, rank - (int(outside[b - 1]) if b else 0)
                needed.setdefault(i, set()).add(b)
        if sum(int(counts[i][b].sum()) for i, bs in needed.items() for b in bs) > ranked_rows:
            return self._one_by_one()
        near = self._near(edges, needed)
        for (f, i), ranks in places.items():
            values = []
            for b, at in ranks.values():
                v, per_fold = near[i, b]
                values.append(float(v[np.searchsorted(np.cumsum(per_fold.sum(axis=1) - per_fold[:, f]), at, side="right")]))
            out[f][i] = values[0] if len(values) == 1 else values[0] + (values[1] - values[0]) * 0.5
        return out

    def _one_by_one(self) -> list[list[float | None]]:
        names, out = [f"c{i}" for i in range(self.columns)], []
        for f in range(self.k):
            found = quantiles(self.data.where(F.col("fold") != f), names, [0.5])
            out.append([found[c][0] for c in names])
        return out

    def _edges(self, rows: int) -> list[np.ndarray]:
        """Cut points around the medians that folds may have, from a sketch of all rows."""
        off = min(_margin(0.5, max(rows, 1), ACCURACY) * SPREAD, 0.5)
        shares = [max(0.0, 0.5 - off), 0.5, min(1.0, 0.5 + off)]
        row = self.data.agg(*[F.percentile_approx(f"c{i}", shares, ACCURACY).alias(f"q{i}") for i in range(self.columns)]).first()
        out = []
        for i in range(self.columns):
            cuts = [float(v) for v in row[i] or [0.0]]
            # a frequent value gets an interval of its own
            own = {edge for v in cuts if math.isfinite(v) for edge in (v, float(np.nextafter(v, math.inf)))}
            out.append(np.array(sorted({-math.inf, math.inf, *own})))
        return out

    def _counts(self, edges: list[np.ndarray]) -> list[np.ndarray]:
        """Rows per interval and fold of each column."""
        k, schema = self.k, pa.schema([("i", pa.int32()), ("b", pa.int32()), ("fold", pa.int32()), ("n", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = [np.zeros((len(e) - 1) * k, np.int64) for e in edges]
            for batch in batches:
                fold = batch.column("fold").to_numpy(zero_copy_only=False)
                for i, e in enumerate(edges):
                    x = batch.column(f"c{i}").to_numpy(zero_copy_only=False).astype(float)
                    here = ~np.isnan(x)
                    totals[i] += np.bincount(_places(x[here], e) * k + fold[here], minlength=len(totals[i]))
            for i, total in enumerate(totals):
                at = np.flatnonzero(total)
                if len(at):
                    columns = [np.full(len(at), i, np.int32), (at // k).astype(np.int32), (at % k).astype(np.int32), total[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

        found = [np.zeros((len(e) - 1, k), np.int64) for e in edges]
        counted = self.data.mapInArrow(run, "i int, b int, fold int, n long").groupBy("i", "b", "fold").agg(F.sum("n").alias("n"))
        for r in counted.collect():  # one row per column, interval and fold
            found[r["i"]][r["b"], r["fold"]] = r["n"]
        return found

    def _near(self, edges: list[np.ndarray], needed: dict[int, set[int]]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """Values and their rows by fold in each needed interval, whose number was checked."""
        schema = pa.schema([("i", pa.int32()), ("b", pa.int32()), ("v", pa.float64()), ("fold", pa.int32())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fold = batch.column("fold").to_numpy(zero_copy_only=False)
                for i, wanted in needed.items():
                    x = batch.column(f"c{i}").to_numpy(zero_copy_only=False).astype(float)
                    b = np.where(np.isnan(x), -1, _places(x, edges[i]))
                    here = np.isin(b, list(wanted))
                    if here.any():
                        columns = [np.full(int(here.sum()), i, np.int32), b[here].astype(np.int32), x[here], fold[here].astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

        rows = self.data.mapInArrow(run, "i int, b int, v double, fold int").groupBy("i", "b", "v", "fold").agg(F.count(F.lit(1)).alias("n"))
        table = rows.toPandas()
        out = {}
        for (i, b), part in table.groupby(["i", "b"]):
            v, at = np.unique(part["v"].to_numpy(), return_inverse=True)
            per_fold = np.zeros((len(v), self.k), np.int64)
            np.add.at(per_fold, (at, part["fold"].to_numpy()), part["n"].to_numpy())
            out[int(i), int(b)] = v, per_fold
        return out


def _texts(folded: DataFrame, columns: Sequence[str], k: int, fold: str) -> list[dict[str, np.ndarray]]:
    """Per text column the rows of each value by fold. The number of values was checked, as dictionaries live here."""
    if not columns:
        return []
    pairs = [x for i, c in enumerate(columns) for x in (F.lit(i), col(c).cast("string"))]
    long = folded.select(F.col(fold).alias("fold"), F.stack(F.lit(len(columns)), *pairs).alias("i", "v")).where(F.col("v").isNotNull())
    found: list[dict[str, np.ndarray]] = [{} for _ in columns]
    for r in long.groupBy("i", "v", "fold").agg(F.count(F.lit(1)).alias("n")).collect():
        found[r["i"]].setdefault(r["v"], np.zeros(k, np.int64))[r["fold"]] = r["n"]
    return found


def fold_pipelines(stages: Sequence, folded: DataFrame, k: int, fold: str = "fold", ranked_rows: int = RANKED_ROWS) -> list[PipelineModel] | None:
    """For each fold the pipeline that ``Pipeline(stages).fit`` makes of the other folds; ``None`` for stages of another
    kind than ``feature_stages`` gives."""
    prep = stages[0]
    if not isinstance(prep, TablePrep) or not prep.get("exact") or not all(isinstance(s, (StringIndexer, OneHotEncoder, VectorAssembler)) for s in stages[1:]):
        return None
    numeric, text = prep.get("numericCols"), prep.get("textCols")
    data = folded.select(F.col(fold).alias("fold"), *[finite_or_null(c).alias(f"c{i}") for i, c in enumerate(numeric)])
    numbers = _Numbers(data, len(numeric), k)
    medians, values = numbers.medians(ranked_rows), _texts(folded, text, k, fold)
    empty = folded.limit(0).drop(fold)
    out = []
    for f in range(k):
        fill = [m if m is not None else 0.0 for m in medians[f]]
        rows = sum(n for g, n in enumerate(numbers.rows) if g != f)
        moments = []
        for i, median in enumerate(fill):
            parts = numbers.outside(f, i)
            moments.append(merged_moments([*parts, (rows - sum(n for n, _, _ in parts), median, 0.0)]))
        tops, labels = [], []
        for counted in values:
            here = {v: int(n.sum() - n[f]) for v, n in counted.items() if n.sum() > n[f]}
            top = min(here, key=lambda v: (-here[v], v.encode())) if here else "Unknown"
            tops.append(top)
            labels.append(list(here) or [top])
        fitted = TablePrepModel()
        fitted._set(
            numericCols=numeric, textCols=text, plainCols=prep.get("plainCols"), medians=fill, means=[m for _, m, _ in moments],
            scales=[math.sqrt(v) or 1.0 for _, _, v in moments], fills=tops,
        )
        models, seen = [fitted], fitted.transform(empty)
        for stage in stages[1:]:
            if isinstance(stage, StringIndexer):
                # the values themselves are all it has to read
                model = stage.fit(folded.sparkSession.createDataFrame(list(zip_longest(*labels)), ", ".join(f"`{c}` string" for c in stage.getInputCols())))
            else:
                # sizes come with the columns' metadata, so nothing is read
                model = stage.fit(seen) if isinstance(stage, OneHotEncoder) else stage
            models.append(model)
            seen = model.transform(seen)
        out.append(PipelineModel(models))
    return out
