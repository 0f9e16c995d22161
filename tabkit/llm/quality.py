"""Quality by co-training: a text classifier and a metadata classifier teach each other, then score together.

The text view holds which words and word beginnings a text has and what its characters are; the metadata view holds
source, language and size. Both are logistic regressions with an absolute (L1) penalty. They start from labelled
rows; in each round every view labels all unlabelled rows, and the other view learns from those that it is most sure
of as well. Labelled rows that took no part in training calibrate each view (Platt scaling) and then weigh the two
calibrated views. Every document is scored by both. One such pair of views is made per target.

Labels meet the documents first; then ``labelled`` rows at most are drawn by a hash of their ids, an equal number for
every target and class, so a rare class is drawn whole. Draws carry the number of rows that they stand for:
calibration weighs them by it, and margins are corrected for it before a view teaches. One row in ``HELD_OUT`` of
each class calibrates. Texts are read once more than the sample: every document becomes its numbers of chosen words
and its shape, in the shared folder, and rounds and scores read those. A round is a narrow pass that gives every
unlabelled row its margins; the cut-off of the ``TAUGHT`` share of rows per class comes from a sketch over all of
them, and of all rows beyond both it and ``CONFIDENCE`` at most ``taught`` per class and view, drawn by a hash among
all of them, are learnt. What is fitted in one task per target is bounded by ``labelled`` and ``taught``; all
else covers all rows.

Defined cases: a null or empty text has no words; null source, language and size are values of their own, and
values that the draws lack weigh nothing. A row without an id is scored like any other, may teach, and has no label.
A repeated label row counts once, a document with contradicting labels once for each; a null label is none, and a
label above one half is positive. Documents that repeat an id share its labels. Where a class has fewer than two
rows, the score is the share of that target's positives (one half without any labels). Columns that bear the name
of a result are replaced.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.llm.common import appended, arrow_schema, extended, slices, stored, without

#: Labelled rows that are fitted, over all targets and classes.
LABELLED = 8_000
#: Pseudo-labelled rows that a view learns per class and round.
TAUGHT_ROWS = 400
ROUNDS = 3
#: Share of the unlabelled rows that a view may label per class and round.
TAUGHT = 0.05
CONFIDENCE = 0.95
#: Words of the text view: of those in at least this many training texts, the most telling ones.
MIN_TEXTS = 3
WORDS = 1 << 11
STEMS = (4, 5)
#: One in this many labelled rows calibrates instead of training.
HELD_OUT = 4
ITERATIONS = 200
#: Strength of the absolute penalty, which keeps the few words that matter.
PENALTY = 2e-3


def look(text: str | None) -> tuple[set[str], list[float]]:
    """The different words of a text with their beginnings (``STEMS`` letters and a star), for languages that
    inflect, and what it is made of: shares of capitals, letters, signs, digits, words, different words and
    lines, and its length in words."""
    data = text.encode() if text else b""
    words = data.lower().translate(_WORD_BYTES).decode().split(" ")
    words = [word for word in words if word]
    size, n, different = max(len(data), 1), max(len(words), 1), set(words)
    terms = different.union(*({f"{word[:stem]}*" for word in different if len(word) > stem} for stem in STEMS))
    letters = max(len(data) - len(data.translate(None, _LETTERS)), 1)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    signs, digits = len(data) - len(data.translate(None, _SIGNS)), len(data) - len(data.translate(None, b"0123456789"))
    return terms, [
        capitals / letters, letters / size, signs / size, digits / size, len(words) / size, len(different) / n,
        data.count(b"\n") / n, math.log1p(len(words)),
    ]


_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_CAPITALS = bytes(range(65, 91))
_SIGNS = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def described(source: str | None, lang: str | None, size: float | None) -> tuple[list[str], float]:
    """The metadata view of a row: source, language and order of size as categories, and the size."""
    known = size is not None and size == size
    scale = math.log1p(min(max(size, 0), 1e300)) if known else 0.0
    return [f"source={source or ''}", f"lang={lang or ''}", f"size={int(2 * scale)}"], scale


def _looked(df: DataFrame) -> DataFrame:
    """The sample without its texts, with their words."""
    schema = extended(df.drop("text"), [T.StructField("words", T.ArrayType(T.StringType()))])
    types = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                yield appended(part.drop_columns(["text"]), [[sorted(look(text)[0]) for text in texts]], types)

    return df.mapInArrow(run, schema)


class View:
    """Rows of one view: numbers of the terms that a row has, and dense values."""

    def __init__(self, terms: list, dense: np.ndarray, width: int) -> None:
        self.terms, self.dense, self.width = terms, dense, width

    def _flat(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = [len(self.terms[i]) for i in at]
        rows = np.repeat(np.arange(len(at)), sizes)
        return rows, np.concatenate([np.asarray(self.terms[i], np.int64) for i in at]) if len(at) else rows

    def fit(self, at: np.ndarray, labels: np.ndarray) -> dict:
        """Logistic regression on the rows ``at``, by accelerated proximal gradient steps on scaled columns."""
        rows, columns = self._flat(at)
        share = np.bincount(columns, minlength=self.width) / len(at)
        spread = np.sqrt(share * (1 - share))
        scale = np.divide(1, spread, out=np.zeros(self.width), where=spread > 0)
        mean, deviation = self.dense[at].mean(axis=0), self.dense[at].std(axis=0)
        deviation[deviation == 0] = np.inf
        dense = np.column_stack([(self.dense[at] - mean) / deviation, np.ones(len(at))])

        def forward(w: np.ndarray) -> np.ndarray:
            return np.bincount(rows, weights=(w[:self.width] * scale)[columns], minlength=len(at)) + dense @ w[self.width:]

        def backward(r: np.ndarray) -> np.ndarray:
            return np.concatenate([np.bincount(columns, weights=r[rows], minlength=self.width) * scale, dense.T @ r])

        probe = np.ones(self.width + dense.shape[1])
        for _ in range(15):
            probe = backward(forward(probe))
            norm = np.linalg.norm(probe)
            probe /= norm
        step = 1 / (1.1 * norm / (4 * len(at)))
        threshold = np.full(len(probe), step * PENALTY)
        threshold[-1] = 0  # the offset is not held down
        w = ahead = np.zeros(len(probe))
        momentum = 1.0
        for _ in range(ITERATIONS):
            chance = 1 / (1 + np.exp(-np.clip(forward(ahead), -30, 30)))
            moved = ahead - step * backward(chance - labels) / len(at)
            new = np.sign(moved) * np.maximum(np.abs(moved) - threshold, 0)
            following = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
            ahead, w, momentum = new + (momentum - 1) / following * (new - w), new, following
        values = w[self.width:-1] / deviation
        return {"terms": (w[:self.width] * scale).tolist(), "dense": values.tolist(), "offset": float(w[-1] - values @ mean)}

    def margin(self, model: dict, at: np.ndarray) -> np.ndarray:
        rows, columns = self._flat(at)
        weights = np.asarray(model["terms"])[columns] if len(columns) else np.empty(0)
        return np.bincount(rows, weights=weights, minlength=len(at)) + self.dense[at] @ np.asarray(model["dense"]) + model["offset"]


def _platt(margins: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> tuple[list[float], float]:
    """Slopes, none below zero, and offset that turn margins into log odds: Newton's method on the held-out rows,
    each weighed by the rows that it stands for. The ridge shrinks with the lighter class, or it would outweigh it."""
    used, mass = list(range(margins.shape[1])), shares * (len(shares) / shares.sum())
    lighter = min(mass[labels == 0].sum(), mass[labels == 1].sum())
    ridge = 2e-3 * lighter / len(labels) ** 0.5
    while True:
        x, w = np.column_stack([margins[:, used], np.ones(len(labels))]), np.zeros(len(used) + 1)
        for _ in range(50):
            chance = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            bend = (x * (mass * chance * (1 - chance))[:, None]).T @ x + ridge * np.eye(len(w))
            step = np.linalg.solve(bend, x.T @ (mass * (labels - chance)) - ridge * w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        if (w[:-1] >= 0).all():
            weights = np.zeros(margins.shape[1])
            weights[used] = w[:-1]
            return weights.tolist(), float(w[-1])
        used = [column for column, weight in zip(used, w[:-1], strict=True) if weight > 0]


#: Which view a lesson is for; a labelled row is for both.
BOTH, TEXT, META = 0, 1, 2


def lesson(part: pd.DataFrame, vocabulary: int, last: bool) -> dict:
    """The views of one target, fitted on its labelled rows and on what each was taught; calibrated if it is the last
    time. Columns: key, terms, shape, source, lang, size, label, held, share (rows that a row stands for), view."""
    part = part.sort_values(["view", "key", "label"], kind="stable", ignore_index=True)
    labels, held, view_of = part["label"].to_numpy(np.float64), part["held"].to_numpy(bool), part["view"].to_numpy()
    base, check = np.flatnonzero((view_of == BOTH) & ~held), np.flatnonzero((view_of == BOTH) & held)
    if any(len(set(labels[rows].tolist())) < 2 for rows in (base, check)):
        shares, known = part["share"].to_numpy(np.float64), view_of == BOTH
        return {"constant": float(labels[known] @ shares[known] / shares[known].sum()) if known.any() else 0.5}
    metadata = [described(*row) for row in zip(part["source"], part["lang"], part["size"], strict=True)]
    categories = {c: i for i, c in enumerate(sorted({c for i in base for c in metadata[i][0]}))}
    views = {
        "text": View(part["terms"].tolist(), np.stack(part["shape"].to_numpy()), vocabulary),
        "meta": View([[categories[c] for c in names if c in categories] for names, _ in metadata], np.array([[size] for _, size in metadata]), len(categories)),
    }
    models = {}
    for name, number in (("text", TEXT), ("meta", META)):
        rows = np.concatenate([base, np.flatnonzero(view_of == number)])
        models[name] = views[name].fit(rows, labels[rows])
    # draws hold as many rows of either class; all rows do not
    stood = [part["share"].to_numpy(np.float64)[base][labels[base] == c] for c in (0, 1)]
    prior = math.log(stood[1].sum() / stood[0].sum()) - math.log(len(stood[1]) / len(stood[0]))
    made = {"views": models, "categories": categories, "prior": prior}
    if last:
        odds, shares = [], part["share"].to_numpy(np.float64)[check]
        for name, view in views.items():
            margins = view.margin(models[name], check)[:, None]
            slopes, offset = _platt(margins, labels[check], shares)
            models[name] |= {"slope": slopes[0], "shift": offset}
            odds.append(slopes[0] * margins[:, 0] + offset)
        made["weights"], made["offset"] = _platt(np.column_stack(odds), labels[check], shares)
    return made


def _margins(model: dict, terms: list[np.ndarray], shapes: np.ndarray, metadata: list[tuple[list[str], float]]) -> tuple[np.ndarray, np.ndarray]:
    """The margins of rows in the text and in the metadata view."""
    text, meta, categories = model["views"]["text"], model["views"]["meta"], model["categories"]
    everyone = np.arange(len(terms))
    told = View(terms, shapes, len(text["terms"])).margin(text, everyone)
    named = [[categories[n] for n in names if n in categories] for names, _ in metadata]
    return told, View(named, np.array([[size] for _, size in metadata]), len(categories)).margin(meta, everyone)


def _scores(model: dict, terms: list, shapes: np.ndarray, metadata: list) -> np.ndarray:
    """The chance of a positive for each row."""
    if "constant" in model:
        return np.full(len(terms), model["constant"])
    (by_text, by_meta), text, meta = model["weights"], model["views"]["text"], model["views"]["meta"]
    told, known = _margins(model, terms, shapes, metadata)
    odds = model["offset"] + by_text * (text["slope"] * told + text["shift"]) + by_meta * (meta["slope"] * known + meta["shift"])
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


#: Rows whose texts, and whose features, are held as Python objects at a time.
LOOKED = 256
SCORED = 2048


def _rows_of(terms: pa.Array, shape: pa.Array, source: pa.Array, lang: pa.Array, size: pa.Array) -> tuple[list, np.ndarray, list]:
    """Terms, shapes and metadata of rows of features."""
    shapes = shape.flatten().to_numpy(zero_copy_only=False).reshape(len(terms), -1)
    metadata = [described(*row) for row in zip(source.to_pylist(), lang.to_pylist(), size.to_pylist(), strict=True)]
    return [np.asarray(t, np.int64) for t in terms.to_pylist()], shapes, metadata


FEATURES = ["__id", "__key", "__source", "__lang", "__size", "__terms", "__shape"]


@dataclass
class QualityModel:
    """``models``: what ``lesson`` made for each target; ``columns``: names of text, source, language and size."""

    vocabulary: list[str]
    models: dict[str, dict]
    columns: dict[str, str]

    def features(self, docs: DataFrame, id_col: str | None, kept: list[str]) -> DataFrame:
        """The columns ``kept`` of every document, and what the views see of it. One narrow pass over whole texts."""
        text, source, lang, size = (self.columns[c] for c in ("text", "source", "lang", "size"))
        ident = F.col(id_col) if id_col else F.lit(None)
        shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(self.vocabulary)})

        @F.arrow_udf("struct<terms array<int>, shape array<double>>")
        def seen(texts: pa.Array) -> pa.Array:
            number = shared.value
            chosen, terms, shapes = number.keys(), [], []
            for start in range(0, len(texts), LOOKED):
                for value in texts.slice(start, LOOKED).to_pylist():
                    words, shape = look(value)
                    terms.append(sorted([number[w] for w in words & chosen]))
                    shapes.append(shape)
            return pa.StructArray.from_arrays(
                [pa.array(terms, pa.list_(pa.int32())), pa.array(shapes, pa.list_(pa.float64()))], names=["terms", "shape"]
            )

        # only the text goes to Python and only what is seen comes back; the other columns stay where they are
        return docs.select(
            *[F.col(f"`{c}`") for c in kept], ident.alias("__id"), F.xxhash64(ident, text, source, lang, size).alias("__key"),
            F.col(source).cast("string").alias("__source"), F.col(lang).cast("string").alias("__lang"), F.col(size).cast("double").alias("__size"),
            seen(F.col(text).cast("string")).alias("__seen"),
        ).select(*[F.col(f"`{c}`") for c in kept], *FEATURES[:5], F.col("__seen.terms").alias("__terms"), F.col("__seen.shape").alias("__shape"))

    def scored(self, features: DataFrame) -> DataFrame:
        """Features without what the views see, with ``<target>_score``, a probability, for each target."""
        rest = [F.col(f"`{c}`") for c in features.columns if c not in FEATURES]
        shared, kind = features.sparkSession.sparkContext.broadcast(list(self.models.values())), ", ".join(f"s{i} double" for i in range(len(self.models)))

        @F.arrow_udf(f"struct<{kind}>")
        def scores(terms: pa.Array, shape: pa.Array, source: pa.Array, lang: pa.Array, size: pa.Array) -> pa.Array:
            parts = []
            for start in range(0, len(terms), SCORED):
                seen = _rows_of(*[column.slice(start, SCORED) for column in (terms, shape, source, lang, size)])
                parts.append([_scores(model, *seen) for model in shared.value])
            columns = [np.concatenate([part[i] for part in parts]) if parts else np.empty(0) for i in range(len(shared.value))]
            return pa.StructArray.from_arrays([pa.array(column, pa.float64()) for column in columns], names=[f"s{i}" for i in range(len(columns))])

        told = features.select(*rest, scores("__terms", "__shape", "__source", "__lang", "__size").alias("__scores"))
        return told.select(*rest, *[F.col(f"__scores.s{i}").alias(f"{target}_score") for i, target in enumerate(self.models)])

    def score(self, docs: DataFrame) -> DataFrame:
        """Every document with its scores, whether it took part in training or not."""
        return self.scored(self.features(docs, None, without(docs, [f"{t}_score" for t in self.models]).columns))


def _draws(known: DataFrame, targets: int, labelled: int) -> DataFrame:
    """(id, target, label, held, share): labelled rows by hash, as many of every target and class."""
    bound = max(labelled // (2 * targets), 2)
    counts = known.agg(*[F.sum((F.col(f"y{i}") == c).cast("long")).alias(f"n{i}{c}") for i in range(targets) for c in (0, 1)]).first()
    parts = []
    for i in range(targets):
        for c in (0, 1):
            rows = known.filter(F.col(f"y{i}") == c).select("id").distinct().orderBy(F.xxhash64("id", F.lit(i)), "id").limit(bound)
            parts.append(rows.select("id", F.lit(i).alias("target"), F.lit(float(c)).alias("label"), F.lit(float(counts[f"n{i}{c}"] or 0)).alias("n")))
    drawn = stored(reduce(DataFrame.union, parts), "draws")
    group = Window.partitionBy("target", "label")
    place = F.row_number().over(group.orderBy(F.xxhash64("id", "target"), "id"))
    held = place % HELD_OUT == 2 % HELD_OUT
    return stored(drawn.select("id", "target", "label", held.alias("held"), (F.col("n") / F.count("*").over(group)).alias("share")), "lessons")


def co_train(
    docs: DataFrame, labels: DataFrame, targets: list[str], *, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars", keep: list[str] | None = None,
    labelled: int = LABELLED, taught: int = TAUGHT_ROWS, rounds: int = ROUNDS,
) -> tuple[QualityModel, DataFrame]:
    """Co-train one pair of views per target; ``labels`` has the id and a 0/1 column per target. The model, and every
    document's columns (``keep`` of them) with ``<target>_score``."""
    columns = {"text": text_col, "source": source_col, "lang": lang_col, "size": size_col}
    kept = without(docs, [f"{t}_score" for t in targets] + FEATURES).columns if keep is None else keep
    marks = [F.when(F.col(t).isNotNull(), (F.col(t).cast("double") > 0.5).cast("int")).alias(f"y{i}") for i, t in enumerate(targets)]
    every = labels.select(F.col(id_col).alias("id"), *marks).filter("id IS NOT NULL").distinct()
    known = stored(every.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi"), "labels-met")
    lessons = _draws(known, len(targets), labelled)
    model = QualityModel(_vocabulary(docs, lessons, len(targets), id_col, text_col), {}, columns)
    features = stored(model.features(docs, id_col, kept), "features")
    seen = features.select(*FEATURES)
    base = seen.join(F.broadcast(lessons), seen["__id"] == lessons["id"]).select(*FEATURES, "target", "label", "held", "share", F.lit(BOTH).alias("view"))
    base = stored(base.dropDuplicates(["__key", "target", "label"]), "lesson-rows")
    flags = known.groupBy("id").agg(*[F.max(F.col(f"y{i}").isNotNull()).alias(f"k{i}") for i in range(len(targets))])
    made, rows = _fitted(base, len(model.vocabulary), rounds == 1), base
    for at in range(1, rounds):
        learnt = _taught(seen, made, flags, taught)
        rows = base.union(learnt) if learnt is not None else base
        made = _fitted(rows, len(model.vocabulary), at + 1 == rounds)
    model.models = {t: made.get(i, {"constant": 0.5}) for i, t in enumerate(targets)}
    return model, model.scored(features)


def fit(docs: DataFrame, labels: DataFrame, targets: list[str], **options) -> QualityModel:
    """The model of ``co_train`` alone."""
    return co_train(docs, labels, targets, keep=[], **options)[0]


def _fitted(rows: DataFrame, vocabulary: int, last: bool) -> dict[int, dict]:
    """One task per target fits its bounded lessons."""

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part.columns = [c.removeprefix("__") for c in part.columns]
        return pd.DataFrame({"target": [part["target"].iloc[0]], "model": [json.dumps(lesson(part, vocabulary, last))]})

    return {row["target"]: json.loads(row["model"]) for row in rows.groupBy("target").applyInPandas(train, "target int, model string").collect()}


def _taught(seen: DataFrame, made: dict[int, dict], flags: DataFrame, taught: int) -> DataFrame | None:
    """What the views teach each other in a round: lessons with pseudo-labels, from all rows without a label."""
    taught_by = [(i, view, other) for i, model in sorted(made.items()) if "views" in model for view, other in ((TEXT, META), (META, TEXT))]
    if not taught_by:
        return None
    names = [f"m{i}_{view}" for i, view, _ in taught_by]
    narrow = seen.select("__id", "__key")
    schema = extended(narrow, [T.StructField(n, T.DoubleType()) for n in names])
    types, shared = arrow_schema(schema), seen.sparkSession.sparkContext.broadcast([made[i] for i in sorted({i for i, _, _ in taught_by})])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SCORED):
                part = batch.slice(start, SCORED)
                given = _rows_of(*[part.column(c) for c in ("__terms", "__shape", "__source", "__lang", "__size")])
                margins = [m + model["prior"] for model in shared.value for m in _margins(model, *given)]
                yield appended(part.select(["__id", "__key"]), margins, types)

    told = seen.mapInArrow(run, schema).join(flags, F.col("__id") == F.col("id"), "left")
    free = [F.when(~F.coalesce(f"k{i}", F.lit(False)), F.col(n)).alias(n) for n, (i, _, _) in zip(names, taught_by, strict=True)]
    margins = stored(told.select("__key", *free), "margins")
    cuts = margins.agg(*[F.percentile_approx(n, [TAUGHT, 1 - TAUGHT], 10_000).alias(n) for n in names]).first()
    sure, parts = math.log(CONFIDENCE / (1 - CONFIDENCE)), []
    for name, (i, view, other) in zip(names, taught_by, strict=True):
        if cuts[name] is None:
            continue
        low, high = min(cuts[name][0], -sure), max(cuts[name][1], sure)
        for label, chosen in ((0.0, F.col(name) <= low), (1.0, F.col(name) >= high)):
            drawn = margins.filter(chosen).select("__key").distinct().orderBy(F.xxhash64("__key", F.lit(2 * i + view)), "__key").limit(taught)
            parts.append(drawn.select(F.col("__key").alias("k"), F.lit(i).alias("target"), F.lit(label).alias("label"), F.lit(other).alias("view")))
    if not parts:
        return None
    picked = stored(reduce(DataFrame.union, parts), "taught")
    rows = seen.join(F.broadcast(picked), seen["__key"] == picked["k"]).dropDuplicates(["__key", "target", "label", "view"])
    return stored(rows.select(*FEATURES, "target", "label", F.lit(False).alias("held"), F.lit(1.0).alias("share"), "view"), "taught-rows")


def _vocabulary(docs: DataFrame, lessons: DataFrame, targets: int, id_col: str, text_col: str) -> list[str]:
    """For each target the words of its training rows whose share of positive texts is farthest from that of all
    texts, in standard deviations; ``WORDS`` in all. It cannot be empty: a word that no text has stands in."""
    trained = lessons.filter("NOT held").select("id", "target", "label")
    ids = F.broadcast(trained.select("id").distinct())
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id").dropDuplicates()
    sample = stored(_looked(texts), "sample")
    rows = sample.select("id", "words").join(F.broadcast(trained), "id")
    sizes = {row["target"]: (row["n"], row["p"]) for row in rows.groupBy("target").agg(F.count("*").alias("n"), F.avg("label").alias("p")).collect()}
    words = rows.select("target", "label", F.explode("words").alias("w")).groupBy("target", "w").agg(F.count("*").alias("n"), F.sum("label").alias("n1"))
    counted, chosen = stored(words.filter(F.col("n") >= MIN_TEXTS), "words"), set()
    for target, (_, p) in sizes.items():
        if 0 < p < 1:
            apart = F.abs(F.col("n1") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
            best = counted.filter(F.col("target") == target).orderBy(apart.desc(), F.desc("n"), "w").limit(WORDS // targets)
            chosen |= {row["w"] for row in best.select("w").collect()}
    return sorted(chosen) or ["\x00"]
