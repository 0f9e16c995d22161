"""Exact quantiles with linear interpolation, at any table size.

Spark's ``percentile`` keeps every distinct value of a column in one aggregation buffer, which a large
column does not fit. Here three scans do, for any number of columns and probabilities: one counts and lets the
mergeable sketch of ``percentile_approx``, over a sample, *propose* two cut points around each wanted rank; one counts exactly how
many rows lie between the cut points, which tells where each rank is, whatever the sketch proposed; one ranks
the few rows left there in a window. A cut point that is itself the answer, as with few distinct values, needs no
third scan. Where more than ``ranked_rows`` rows are left, sketches of the intervals narrow them further
with every two scans. No pass sorts or shuffles the table, and only cut points, interval
counts and the wanted values reach the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabkit.functions.kinds import as_double

RANKED_ROWS = 1_000_000
#: A sketch takes so many rows, or one in a hundred where that is more. The sample only affects how much is left to rank.
SAMPLE_ROWS = 200_000
#: A sketch is off by one part in so many of its rows at most.
ACCURACY = 10_000
#: Parts into which a sketch cuts an interval that is still too large.
GRID = 1000


@dataclass
class _Interval:
    """Half-open value range [low, high); ``start`` rows of the column lie below it."""

    low: float
    high: float
    start: int
    count: int
    ranks: list[int] = field(default_factory=list)


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    exact: bool = True,
    ranked_rows: int = RANKED_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    accuracy: int = ACCURACY,
) -> dict[str, list[float | None]]:
    """Quantiles of each column over its non-null values; ``None`` where a column has no value."""
    columns, probs = list(columns), [float(p) for p in probs]
    if not columns:
        return {}
    data = df.select(
        *[F.nanvl(as_double(c), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]
    )
    if exact:
        values = _order_statistics(data, probs, ranked_rows, sample_rows, accuracy)
        return {c: values[i] for i, c in enumerate(columns)}
    row = data.agg(*[F.percentile_approx(c, probs).alias(c) for c in data.columns]).first()
    return {c: list(row[i]) if row[i] is not None else [None] * len(probs) for i, c in enumerate(columns)}


def _share(rows: int, sample_rows: int) -> float:
    """The share of ``rows`` that a sketch takes."""
    return min(1.0, max(sample_rows, rows // 100) / rows) if rows else 1.0


def _margin(p: float, sampled: float, accuracy: int) -> float:
    """How far the share ``p`` may lie off in a sketch of so many sampled rows: four standard errors and the sketch's own."""
    return 4 * math.sqrt(p * (1 - p) / sampled) + 2 / sampled + 2 / accuracy


def _order_statistics(
    data: DataFrame, probs: list[float], ranked_rows: int, sample_rows: int, accuracy: int
) -> list[list[float | None]]:
    rows = data.count()
    share = _share(rows, sample_rows)
    margins = [(p, _margin(p, max(1.0, rows * share), accuracy)) for p in probs]
    around = sorted({min(1.0, max(0.0, at)) for p, off in margins for at in (p - off, p + off)})
    drawn = F.col("drawn")
    facts = [
        F.struct(
            F.count(c).alias("n"), F.count_if(F.col(c) == math.inf).alias("infinite"),
            F.percentile_approx(F.when(drawn & (F.col(c) < math.inf), F.col(c)), around, accuracy).alias("cuts"),
        ).alias(c)
        for c in data.columns
    ]
    seen = data.withColumn("drawn", F.rand(0) < share).agg(*facts).first()
    counts = [fact["n"] for fact in seen]
    found: dict[int, dict[int, float]] = defaultdict(dict)
    active: dict[int, list[_Interval]] = {}
    for i, n in enumerate(counts):
        wanted = sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}) if n else []
        finite = n - seen[i]["infinite"]
        found[i].update({r: math.inf for r in wanted if r >= finite})
        if below := [r for r in wanted if r < finite]:
            active[i] = [_Interval(-math.inf, math.inf, 0, finite, below)]
    # the infinity is known by its count, so every interval is half-open
    data = data.select(*[F.when(F.col(c) < math.inf, F.col(c)).alias(c) for c in data.columns])
    proposed, seed = {i: seen[i]["cuts"] or [] for i in active}, 1
    while active:
        if sum(part.count for parts in active.values() for part in parts) <= ranked_rows:
            _rank(_long(data, active), active, found)
            break
        active = _recount(data, active, _edges(proposed, active), found)
        if sum(part.count for parts in active.values() for part in parts) > ranked_rows:
            proposed = _cut_points(_long(data, active), active, sample_rows, accuracy, seed)
            seed += 1

    result: list[list[float | None]] = []
    for i, n in enumerate(counts):
        if not n:
            result.append([None] * len(probs))
            continue
        column = []
        for p in probs:
            position = p * (n - 1)
            low, high = found[i][math.floor(position)], found[i][math.ceil(position)]
            column.append(low if low == high else low + (high - low) * (position - math.floor(position)))
        result.append(column)
    return result


def _places(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each value the number of the half-open interval between two edges that holds it."""
    return np.clip(np.searchsorted(edges, values, side="right") - 1, 0, len(edges) - 2)


def _columns(batch: pa.RecordBatch, numbers: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The values of each column without its nulls."""
    for i in numbers:
        yield i, batch.column(f"c{i}").drop_null().to_numpy(zero_copy_only=False)


def _long(data: DataFrame, active: dict[int, list[_Interval]]) -> DataFrame:
    """(column number, interval number, value) of the rows inside the active intervals."""
    located = {}
    for i, parts in active.items():
        edges = sorted({-math.inf, math.inf, *(p.low for p in parts), *(p.high for p in parts)})
        at = {part.low: j for j, part in enumerate(parts)}
        located[i] = np.array(edges), np.array([at.get(low, -1) for low in edges[:-1]])
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, values in _columns(batch, list(located)):
                edges, numbers = located[i]
                j = numbers[_places(values, edges)]
                inside = j >= 0
                if inside.any():
                    j = j[inside].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i, np.int32)), pa.array(j), pa.array(values[inside])], schema=schema)

    return data.select(*[f"c{i}" for i in active]).mapInArrow(run, "i int, j int, v double")


def _rank(long: DataFrame, active, found) -> None:
    """Rank the rows left, whose number was checked, and fetch only the values at the wanted ranks."""
    wanted = [(i, j, r - p.start, r) for i, parts in active.items() for j, p in enumerate(parts) for r in p.ranks]
    places = long.sparkSession.createDataFrame(wanted, "i int, j int, place long, rank long")
    upto = F.sum("n").over(Window.partitionBy("i", "j").orderBy("v"))
    ranked = long.groupBy("i", "j", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
    hit = (F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n"))
    for r in ranked.join(F.broadcast(places), ["i", "j"]).where(hit).select("i", "rank", "v").collect():
        found[r["i"]][r["rank"]] = r["v"]


def _cut_points(long: DataFrame, active, sample_rows: int, accuracy: int, seed: int) -> dict[int, list[float]]:
    """Values just around each wanted rank, and at it, by a sketch of each interval; the latter halve a small one."""
    share = _share(sum(part.count for parts in active.values() for part in parts), sample_rows)
    grid = [k / GRID for k in range(GRID + 1)]
    drawn = long.sample(fraction=share, seed=seed) if share < 1 else long
    sketches = drawn.groupBy("i", "j").agg(F.count("v").alias("n"), F.percentile_approx("v", grid, accuracy).alias("cuts"))
    cuts: dict[int, list[float]] = defaultdict(list)
    for i, j, n, values in sketches.collect():
        part = active[i][j]
        for rank in part.ranks:
            at = (rank - part.start + 0.5) / part.count
            off = _margin(at, n, accuracy)
            places = (math.floor((at - off) * GRID), round(at * GRID), math.ceil((at + off) * GRID))
            cuts[i] += [values[min(GRID, max(0, place))] for place in places]
    return cuts


def _edges(proposed: dict[int, list[float]], active) -> dict[int, list[float]]:
    """Cut points with the intervals' own ends; each proposed value also gets an interval of its own."""
    edges = {}
    for i, parts in active.items():
        ends = {end for part in parts for end in (part.low, part.high)}
        alone = {edge for v in proposed.get(i, ()) for edge in (v, float(np.nextafter(v, math.inf)))}
        edges[i] = sorted(ends | alone | {-math.inf, math.inf})
    return edges


def _recount(data, active, cuts, found) -> dict[int, list[_Interval]]:
    """Count rows per candidate interval and keep the intervals that hold a wanted rank."""
    bounds = {i: np.array(cuts[i] if len(cuts[i]) > 2 else [-math.inf, 0.0, math.inf]) for i in active}
    schema = pa.schema([("i", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {i: np.zeros(len(edges) - 1, np.int64) for i, edges in bounds.items()}
        for batch in batches:
            for i, values in _columns(batch, list(bounds)):
                totals[i] += np.bincount(_places(values, bounds[i]), minlength=len(totals[i]))
        for i, total in totals.items():
            at = np.flatnonzero(total)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[at])], schema=schema
                )

    counted = data.select(*[f"c{i}" for i in active]).mapInArrow(run, "i int, b int, n long")
    rows = counted.groupBy("i", "b").agg(F.sum("n").alias("count")).collect()
    sizes = {(r["i"], int(r["b"])): r["count"] for r in rows}
    kept: dict[int, list[_Interval]] = {}
    for i, parts in active.items():
        edges = cuts[i] if len(cuts[i]) > 2 else [-math.inf, 0.0, math.inf]
        wanted = sorted(rank for part in parts for rank in part.ranks)
        start = 0
        for b in range(len(edges) - 1):
            count = sizes.get((i, b), 0)
            ranks = [r for r in wanted if start <= r < start + count]
            if ranks and edges[b + 1] == np.nextafter(edges[b], math.inf):
                found[i].update({r: edges[b] for r in ranks})
            elif ranks:
                kept.setdefault(i, []).append(_Interval(edges[b], edges[b + 1], start, count, ranks))
            start += count
    return kept
