"""Second-order boosting against a plain version and between its two ways of running."""

import json

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F
from tabkit.plans import boosting
from tabkit.plans.boosting import Loss, NewtonBoost, NewtonBoostModel


def frame(spark, x, y):
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, x array<double>, label double").withColumn("features", array_to_vector("x"))


def data(n=600, classes=0, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 5, n), rng.normal(size=n).round(1)])
    signal = np.sin(x[:, 0]) * 2 + (x[:, 1] > 2) * x[:, 2] + rng.normal(scale=0.2, size=n)
    return x, signal if not classes else np.digitize(signal, np.quantile(signal, np.linspace(0, 1, classes + 1)[1:-1])).astype(float)


def plain(x, y, classes, rounds, depth, rate=0.1, penalty=1.0, least=1.0):
    """Margins after all rounds, by trying every midpoint between values."""
    loss = Loss(classes)
    margin = np.full((len(y), loss.outputs), loss.start(float(np.mean(y))))

    def grow(rows, g, h, left):
        all_g, all_h = g[rows].sum(), h[rows].sum()
        best = None
        if left:
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[:-1] + values[1:]) / 2:
                    low = rows[x[rows, f] <= cut]
                    lg, lh = g[low].sum(), h[low].sum()
                    if lh >= least and all_h - lh >= least:
                        gain = (lg**2 / (lh + penalty) + (all_g - lg) ** 2 / (all_h - lh + penalty) - all_g**2 / (all_h + penalty)) / 2
                        if gain > 1e-10 and (best is None or gain > best[0] * (1 + 1e-9)):
                            best = gain, f, cut
        out = np.zeros(len(y))
        if best is None:
            out[rows] = -rate * all_g / (all_h + penalty)
            return out
        side = x[rows, best[1]] <= best[2]
        return grow(rows[side], g, h, left - 1) + grow(rows[~side], g, h, left - 1)

    for _ in range(rounds):
        g, h = loss.steps(y, margin)
        margin = margin + np.column_stack([grow(np.arange(len(y)), g[:, k], h[:, k], depth) for k in range(loss.outputs)])
    return margin


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_equals_trying_every_split(spark, classes):
    x, y = data(classes=classes)
    df = frame(spark, x, y)
    model = NewtonBoost(classes=classes, rounds=4, depth=3).fit(df)
    margin = plain(x, y, classes, 4, 3)
    found = model.transform(df).orderBy("id")
    if not classes:
        got = np.array([r["prediction"] for r in found.select("prediction").collect()])
        assert np.allclose(got, margin[:, 0], atol=1e-9)
        return
    rows = found.select(vector_to_array("probability").alias("p"), "prediction").collect()
    chance = np.array([r["p"] for r in rows])
    assert np.allclose(chance, Loss(classes).chances(margin), atol=1e-9) and np.allclose(chance.sum(axis=1), 1)
    assert [r["prediction"] for r in rows] == chance.argmax(axis=1).tolist()


@pytest.mark.parametrize("classes", [0, 3])
def test_many_tasks_grow_the_trees_of_one(spark, classes, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    monkeypatch.setattr(boosting, "HISTOGRAM_CELLS", 200)
    x, y = data(400, classes)
    df = frame(spark, x, y).repartition(4)
    df.persist()
    params = {"classes": classes, "rounds": 3, "depth": 3, "subsample": 0.8}
    one, many = NewtonBoost(**params).fit(df), NewtonBoost(taskCells=0, **params).fit(df)
    a, b = json.loads(one.get("trees")), json.loads(many.get("trees"))
    assert [[t["feature"] for t in r] for r in a] == [[t["feature"] for t in r] for r in b]
    assert [[t["cut"] for t in r] for r in a] == [[t["cut"] for t in r] for r in b]
    assert np.allclose([v for r in a for t in r for v in t["value"]], [v for r in b for t in r for v in t["value"]])
    df.unpersist()


def test_depth_one_round_one_is_the_best_split(spark):
    x, y = data(300)
    model = NewtonBoost(rounds=1, depth=1, rate=1.0, penalty=0.0).fit(frame(spark, x, y))
    tree = json.loads(model.get("trees"))[0][0]
    best = min(
        (((y[x[:, f] <= c] - y[x[:, f] <= c].mean()) ** 2).sum() + ((y[x[:, f] > c] - y[x[:, f] > c].mean()) ** 2).sum(), f, c)
        for f in range(3) for c in (np.unique(x[:, f])[:-1] + np.unique(x[:, f])[1:]) / 2
    )
    assert (tree["feature"][0], tree["cut"][0]) == best[1:]


def test_wide_bins_constant_features_and_one_class(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=900), np.ones(900)])
    df = frame(spark, x, x[:, 0] ** 2)
    model = NewtonBoost(rounds=30, depth=3, maxBins=400, rate=0.3).fit(df)
    scored = model.transform(df)
    assert scored.agg(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0] < 0.05
    assert model.featureImportances.toArray().tolist() == [1.0, 0.0] and model.getNumTrees == 30
    model.write().overwrite().save(str(tmp_path / "m"))
    again = NewtonBoostModel.load(str(tmp_path / "m")).transform(df)
    assert again.select("id", "prediction").exceptAll(scored.select("id", "prediction")).count() == 0
    same = NewtonBoost(classes=2, rounds=2).fit(frame(spark, x, np.zeros(900)))
    assert same.transform(df).filter("prediction != 0").count() == 0 and same.featureImportances.toArray().sum() == 0


@pytest.mark.parametrize("cells", [0, 10**9])
def test_equal_rows_are_held_once(spark, cells):
    """Six times the rows are as many rows in blocks, with weights, and grow the trees of all rows."""
    x, y = data(150, 2)
    many = np.concatenate([x] * 6), np.concatenate([y] * 6)
    df = frame(spark, *many).repartition(5)
    cuts = boosting.cuts_of(df, "features")
    blocks = boosting.blocked(df, "features", "label", cuts, 0.0, 1, len(many[1]))
    held = [boosting.Block.read(r.asDict(), 3, 1, False) for r in blocks.collect()]
    different = len(np.unique(np.column_stack([x, y]), axis=0))
    assert sum(len(b.label) for b in held) == different and sum(b.weight.sum() for b in held) == 900
    model = NewtonBoost(classes=2, rounds=3, depth=3, taskCells=cells).fit(df)
    margin = plain(*many, 2, 3, 3)
    got = np.array([r["p"] for r in model.transform(df).orderBy("id").select(vector_to_array("probability").alias("p")).collect()])
    assert np.allclose(got, Loss(2).chances(margin), atol=1e-9)
