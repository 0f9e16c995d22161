"""Forests against plain trees, and trees grown in many passes against those of one task."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from tabkit.operators.target import CLASSIFICATION, REGRESSION
from tabkit.plans import forest as R
from tabkit.plans.models import get_estimator


def frame(spark, x, y):
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, x array<double>, label double").withColumn("features", array_to_vector("x"))


def data(n=500, classes=0, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 2, n), rng.integers(0, 2, n), rng.integers(-3, 9, n) / 2])
    signal = np.sin(x[:, 0]) * 2 + x[:, 1] * x[:, 3] + rng.normal(scale=0.3, size=n).round(1)
    return x, signal if not classes else np.digitize(signal, np.quantile(signal, np.linspace(0, 1, classes + 1)[1:-1])).astype(float)


def plain(x, y, w, classes, depth, least):
    """Values of one tree for all rows, by trying every midpoint between values with all features."""

    def score(rows):
        n = w[rows].sum()
        if not n:
            return 0.0
        return sum((w[rows] * (y[rows] == k)).sum() ** 2 for k in range(classes)) / n if classes else (w[rows] * y[rows]).sum() ** 2 / n

    def grow(rows, left, out):
        best = None
        if left and w[rows].sum() >= 2 * least:
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[:-1] + values[1:]) / 2:
                    side = x[rows, f] <= cut
                    if min(w[rows[side]].sum(), w[rows[~side]].sum()) >= least:
                        gain = score(rows[side]) + score(rows[~side]) - score(rows)
                        if gain > 1e-8 and (best is None or gain > best[0] + 1e-9 * max(1, abs(best[0]))):
                            best = gain, f, cut
        if best is None:
            n = w[rows].sum()
            out[rows] = [(w[rows] * (y[rows] == k)).sum() / n for k in range(classes)] if classes else (w[rows] * y[rows]).sum() / n
            return
        side = x[rows, best[1]] <= best[2]
        grow(rows[side], left - 1, out)
        grow(rows[~side], left - 1, out)

    out = np.zeros((len(y), classes or 1))
    grow(np.arange(len(y)), depth, out)
    return out


def planned(spark, x, y, classes):
    df = frame(spark, x, y).repartition(3)
    cuts = R.cuts_of(df, "features", x.shape[1])
    start = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])]).astype(np.int64)
    usual = start[:-1] + np.array([np.searchsorted(c, 0.0) for c in cuts])
    plan = R.Plan(classes, start, usual, 3, 5, 2, x.shape[1], 42, 0.0, np.zeros(classes or 1))
    return plan, cuts, R.blocked(df, "features", "label", cuts, plan, len(y))


@pytest.mark.parametrize("classes", [0, 3])
def test_a_tree_equals_trying_every_split(spark, monkeypatch, classes):
    monkeypatch.setattr(R, "BLOCK_ROWS", 50)
    monkeypatch.setattr(R, "NODE_CELLS", 300)
    x, y = data(240, classes)
    plan, cuts, blocks = planned(spark, x, y, classes)
    held = R.Rows.read([b.asDict() for b in blocks.collect()])
    assert held.weight.sum() == 240 and len(held.weight) == len(np.unique(np.column_stack([x, y]), axis=0))
    tree, bounds = R.grown(held, plan, 0, 1, 0), np.concatenate([np.append(c, np.inf) for c in cuts])
    got = R._Scorer(plan.owner[tree.cut], bounds[tree.cut], tree.left, tree.gain, tree.value).told(np.ascontiguousarray(x.T))
    assert np.allclose(got, plain(x, y, np.ones(len(y)), classes, 5, 2), atol=1e-9)


@pytest.mark.parametrize("classes, subset", [(0, "all"), (3, "sqrt")])
def test_passes_over_blocks_grow_the_trees_of_one_task(spark, monkeypatch, classes, subset):
    monkeypatch.setattr(R, "BLOCK_ROWS", 60)
    monkeypatch.setattr(R, "HISTOGRAM_CELLS", 2000)
    x, y = data(400, classes)
    df = frame(spark, x, y).repartition(4).persist()
    told, shares, sizes = [], [], []
    for cells in (0, 200, 10**9):
        model = R.Forest(classes=classes, subset=subset, trees=5, depth=6, taskCells=cells).fit(df)
        told.append(np.array([t.told(np.ascontiguousarray(x.T)) for t in model.grown]))
        shares.append(model.featureImportances.toArray())
        sizes.append([len(t.left) for t in model.grown])
    df.unpersist()
    assert sizes[0] == sizes[1] == sizes[2] and min(sizes[0]) > 15
    assert np.allclose(told[0], told[2]) and np.allclose(told[1], told[2])
    assert np.allclose(shares[0], shares[2]) and np.allclose(shares[1], shares[2])


@pytest.mark.parametrize("classes", [0, 3])
def test_repeated_rows_are_held_once(spark, classes):
    """Work does not grow with copies: forty times the rows are the same stored rows with weights."""
    x, y = data(150, classes)
    one = planned(spark, x, y, classes)[2].agg(F.sum("rows"), F.sum(F.octet_length("codes"))).first()
    many = planned(spark, np.concatenate([x] * 40), np.concatenate([y] * 40), classes)[2].agg(F.sum("rows"), F.sum(F.octet_length("codes"))).first()
    assert one == many


def test_draws_of_a_counted_row_are_those_of_its_copies():
    plan = R.Plan(2, np.array([0, 2]), np.array([0]), 1, 5, 1, 1, 42, 0.0, np.zeros(2))
    n = plan.drawn(0, 7, np.full(20_000, 9))
    assert abs(n.mean() - 9) < 0.1 and abs(n.var() - 9) < 0.4  # Poisson: weights times one draw would have a variance of 81
    assert (n == plan.drawn(0, 7, np.full(20_000, 9))).all() and (n != plan.drawn(1, 7, np.full(20_000, 9))).any()


def test_features_tried_at_a_node():
    plan = R.Plan(2, np.arange(0, 22, 2), np.arange(0, 20, 2), 1, 5, 1, 4, 42, 0.0, np.zeros(2))
    tried = plan.tried(3, np.arange(1, 5001))
    assert (tried.sum(axis=1) == 4).all() and np.abs(tried.mean(axis=0) - 0.4).max() < 0.03
    assert (tried[17:30] == plan.tried(3, np.arange(18, 31))).all() and (tried != plan.tried(4, np.arange(1, 5001))).any()


def test_sparse_vectors_and_many_values(spark):
    """Sparse and dense forms of a row are one row; more than 32 values become quantile bins."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random((600, 6)) < 0.7, 0.0, rng.normal(size=(600, 6)).round(2))
    rows = [(Vectors.dense(r) if i % 2 else Vectors.sparse(6, [(j, v) for j, v in enumerate(r) if v]), float(r[0] > 0)) for i, r in enumerate(np.repeat(x, 2, axis=0))]
    df = spark.createDataFrame(rows, ["features", "label"])
    cuts = R.cuts_of(df, "features", 6)
    assert max(map(len, cuts)) <= 31 and min(map(len, cuts)) > 5
    model = R.Forest(classes=2, trees=10, taskCells=0).fit(df)
    assert model.transform(df).filter("prediction != label").count() == 0
    assert model.featureImportances.toArray()[0] > 0.9


def test_saved_forests_one_row_and_one_class(spark, tmp_path):
    x, y = data(200, 3)
    df = frame(spark, x, y)
    for name, problem in (("Random Forest", CLASSIFICATION), ("Random Forest", REGRESSION)):
        model = get_estimator(name, problem, n_estimators=7).fit(df)
        assert model.getNumTrees == 7 and model.numFeatures == 4 and abs(model.featureImportances.toArray().sum() - 1) < 1e-9
        model.write().overwrite().save(str(tmp_path / problem))
        scored, again = model.transform(df), R.ForestModel.load(str(tmp_path / problem)).transform(df)
        assert again.select("id", "prediction").exceptAll(scored.select("id", "prediction")).count() == 0
        assert scored.filter("abs(prediction - label) > 0.9").count() < 40
    chances = np.array([r["p"] for r in get_estimator("Random Forest", CLASSIFICATION, n_estimators=7).fit(df).transform(df).select(vector_to_array("probability").alias("p")).collect()])
    assert np.allclose(chances.sum(axis=1), 1)
    # a tree may draw no row of a table of one
    single = get_estimator("Random Forest", REGRESSION, n_estimators=20).fit(frame(spark, x[:1], np.array([5.0])))
    assert single.transform(df).filter("abs(prediction - 5) > 1e-9").count() == 0
    same = get_estimator("Random Forest", CLASSIFICATION, n_estimators=5).fit(frame(spark, x, np.zeros(200)))
    assert same.transform(df).filter("prediction != 0").count() == 0 and same.featureImportances.toArray().sum() == 0


def test_importance_of_deep_trees_takes_no_more_jobs(spark):
    """A forest that fits into tasks takes as many jobs as a flat one; Spark's own took one more for every level."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 30, 3000), rng.integers(0, 30, 3000), rng.integers(0, 2, 3000)])
    y = (x[:, 0] // 4 % 3 * (rng.random(3000) < 0.9)).astype(float)
    df, context = frame(spark, x, y).persist(), spark.sparkContext
    df.count()
    jobs = []
    for depth in (2, None):
        context.setJobGroup(f"forest-{depth}", "fit")
        model = get_estimator("Random Forest", CLASSIFICATION, n_estimators=10, max_depth=depth).fit(df)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"forest-{depth}")))
    context.setJobGroup("other", "other")
    assert jobs[0] == jobs[1] > 0 and min(len(t.left) for t in model.grown) > 100
    shares = model.featureImportances.toArray()
    each = [np.bincount(t.feature[t.left >= 0], t.gain[t.left >= 0], 3) for t in model.grown]
    assert np.allclose(shares, np.mean([e / e.sum() for e in each], axis=0)) and shares.argmax() == 0
    df.unpersist()


def test_no_task_gets_more_than_it_may_hold(spark, monkeypatch):
    """Nodes that are sent to tasks hold at most ``taskCells`` stored bins, and all rows of a tree are in one or in a finished leaf."""
    x, y = data(400, 0)
    sent = []
    monkeypatch.setattr(R, "_finished", lambda blocks, plan, tops, nodes, own=R._finished: sent.append((blocks, plan, tops, nodes)) or own(blocks, plan, tops, nodes))
    R.Forest(trees=4, depth=8, taskCells=200).fit(frame(spark, x, y))
    (blocks, plan, tops, nodes), = sent
    held: dict[tuple[int, int], int] = {}
    for block in blocks.collect():
        rows = R.Rows.read([block.asDict()])
        for top in tops:
            here, drawn = top.places(rows, plan), plan.drawn(top.tree, block["block"], rows.weight) > 0
            for node, n in zip(*np.unique(here[rows.row[drawn[rows.row]]], return_counts=True), strict=True):
                held[top.tree, int(node)] = held.get((top.tree, int(node)), 0) + int(n)
    assert len(nodes) > 8 and all(node in nodes or node[1] in tops[node[0]].leaf for node in held)
    assert max(held.get(node, 0) for node in nodes) <= 1.2 * 200  # sizes are counted in rows of the average length
