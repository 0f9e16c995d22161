"""The exact kernel machine and the epsilon-insensitive regression against their optimality conditions."""

import json

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F
from tabkit.operators.target import CLASSIFICATION, REGRESSION
from tabkit.plans import epsilon, fourier, kernels
from tabkit.plans import models as D


def frame(spark, x, y):
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, x array<double>, label double").withColumn("features", array_to_vector("x"))


def blobs(n=300, classes=2, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    angle = 2 * np.pi * y / classes
    return np.column_stack([np.cos(angle), np.sin(angle)]) * 2 + rng.normal(0, spread, (n, 2)), y.astype(float)


def conditions(x, y, model, number, a, b, c, gamma, near=6e-3):
    """Every row's condition, with multipliers of equal rows taken together."""
    vectors, weights, offset = model._machines()[number]
    here = (y == a) | (y == b)
    side = np.where(y[here] == b, 1.0, -1.0)
    margin = kernels._decided(x[here], (vectors, weights, offset), gamma) * side
    alpha = np.array([abs(weights[(vectors == v).all(axis=1)].sum()) for v in x[here]])
    assert abs(weights.sum()) < 1e-6
    assert (margin[alpha == 0] >= 1 - near).all()
    free = (alpha > 0) & (alpha < c * (1 - 1e-9))
    assert (np.abs(margin[free] - 1) <= near).all() and (margin[alpha >= c * (1 - 1e-9)] <= 1 + near).all()


@pytest.mark.parametrize("part", [40, 10_000])
def test_cascade_ends_at_the_optimum_for_all_rows(spark, part, monkeypatch):
    monkeypatch.setattr(kernels, "VIOLATORS", 7)
    x, y = blobs()
    model = kernels.KernelMachine(C=3.0, gamma=0.4, partRows=part).fit(frame(spark, x, y))
    conditions(x, y, model, 0, 0, 1, 3.0, 0.4)
    whole, offset = kernels.solve(x, np.where(y == 1, 1.0, -1.0), 3.0, 0.4, tolerance=1e-6)
    mine = kernels._decided(x, model._machines()[0], 0.4)
    theirs = kernels.kernel(x, x, 0.4) @ (whole * np.where(y == 1, 1.0, -1.0)) + offset
    assert np.abs(mine - theirs).max() < 0.02


def test_several_classes_copies_and_saving(spark, tmp_path):
    x, y = blobs(200, 3, 1, 0.6)
    x, y = np.concatenate([x, x[:40], x[:1].repeat(30, axis=0)]), np.concatenate([y, y[:40], y[:1].repeat(30)])
    df = frame(spark, x, y)
    model = D.get_estimator("Support Vector Machine (SVM)", CLASSIFICATION, method="exact", gamma="0.5").fit(df)
    scored = model.transform(df)
    assert scored.filter("prediction = label").count() / len(y) > 0.95 and D.model_size(model)["support_vectors"] == model.support
    model.write().overwrite().save(str(tmp_path / "svm"))
    again = kernels.KernelModel.load(str(tmp_path / "svm")).transform(df)
    assert again.select("id", "prediction").exceptAll(scored.select("id", "prediction")).count() == 0


def test_matrix_and_rows_give_one_solution(monkeypatch):
    x, y = blobs(120, seed=3)
    side = np.where(y == 1, 1.0, -1.0)
    a, b = kernels.solve(x, side, 1.0, 0.5)
    monkeypatch.setattr(kernels, "MATRIX_ROWS", 10)
    c, d = kernels.solve(x, side, 1.0, 0.5)
    assert np.allclose(a, c) and abs(b - d) < 1e-9


def test_wide_boxes_do_not_take_more_steps(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1000, 2)) * 2
    side, calls, plain = np.where(np.sin(2 * x[:, 0]) + x[:, 1] > rng.normal(size=1000) * 0.3, 1.0, -1.0), [], kernels.kernel
    monkeypatch.setattr(kernels, "MATRIX_ROWS", 50)  # kernel rows are then computed step by step
    monkeypatch.setattr(kernels, "kernel", lambda *a: calls.append(1) or plain(*a))
    c = np.full(1000, 20_000.0)
    alpha, offset = kernels.solve(x, side, c, 0.3)
    assert len(calls) < 6000 and abs(side @ alpha) < 1e-6 and (alpha >= 0).all() and (alpha <= c).all()
    margin = (plain(x, x, 0.3) @ (alpha * side) + offset) * side
    assert (margin[alpha == 0] >= 1 - 2e-3).all() and (margin[alpha == c] <= 1 + 2e-3).all()
    assert (np.abs(margin[(alpha > 0) & (alpha < c)] - 1) <= 2e-3).all()


def test_factor_is_the_kernel_or_refused():
    x, _ = blobs(400, seed=6)
    half = kernels.factor(x, 0.4, 400)
    assert half.shape[1] < 300 and np.abs(half @ half.T - kernels.kernel(x, x, 0.4)).max() < 1e-8
    assert kernels.factor(x, 0.4, 20) is None
    assert kernels.factor(np.arange(50.0)[:, None] * 100, 1.0, 50).shape == (50, 50)
    assert kernels.factor(np.ones((5, 2)), 1.0, 5).shape == (5, 1)


def test_parts_of_a_level_are_solved_in_different_tasks(spark):
    x, y = blobs(400, seed=7)
    machine = kernels.KernelMachine(partRows=50)
    rows = machine._rows(frame(spark, x, y)).withColumn("part", F.pmod("id", F.lit(8))).withColumn("alpha", F.lit(0.0)).withColumn("offset", F.lit(0.0))
    tasks = machine._solved(rows).withColumn("task", F.spark_partition_id()).agg(F.countDistinct("task")).first()[0]
    assert tasks > 2


def test_too_many_support_vectors_are_refused(spark):
    x, y = blobs(200, spread=5)
    with pytest.raises(ValueError, match="support vectors"):
        kernels.KernelMachine(partRows=50, maxSupport=30).fit(frame(spark, x, y))


@pytest.mark.parametrize("cells", [0, 10**7])
def test_epsilon_regression_is_near_its_bound(spark, cells, monkeypatch):
    monkeypatch.setattr(epsilon, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(250, 3))
    y = x @ [2.0, -1.0, 0.0] + 4 + rng.standard_t(2, 250)
    model = epsilon.EpsilonRegression(C=0.7, epsilon=0.5, taskCells=cells).fit(frame(spark, x, y).repartition(3))
    w, b = model.coefficients.toArray(), model.intercept
    value = w @ w / 2 + 0.7 * np.maximum(np.abs(y - x @ w - b) - 0.5, 0).sum()
    bound = model.getOrDefault(model.bound)
    assert abs(value - model.getOrDefault(model.objective)) < 1e-9 * value and bound <= value <= bound * 1.001
    for _ in range(200):  # no neighbour is better by more than the gap
        other = np.append(w, b) + rng.normal(0, 0.05, 4)
        assert other[:3] @ other[:3] / 2 + 0.7 * np.maximum(np.abs(y - x @ other[:3] - other[3]) - 0.5, 0).sum() >= bound


def test_support_vector_regression_follows_a_curve(spark, tmp_path):
    x = np.linspace(-3, 3, 200)[:, None]
    df = frame(spark, x, np.sin(x[:, 0]) * 2)
    model = D.get_estimator("Support Vector Regression (SVR)", REGRESSION, C=10.0).fit(df)
    error = model.transform(df).agg(F.max(F.abs(F.col("prediction") - F.col("label")))).first()[0]
    assert error < 0.4 and json.dumps(D.model_size(model))
    flat = epsilon.EpsilonRegression().fit(frame(spark, x, np.full(200, 3.0)))
    assert abs(flat.intercept - 3) <= 0.1 + 1e-6 and np.abs(flat.coefficients.toArray()).max() < 1e-6
    assert vector_to_array("features") is not None


def test_copies_are_one_row_and_solutions_are_taken_up(spark, monkeypatch):
    """Eight copies of every row make no more support vectors; a solved problem is not solved again from nothing."""
    x, y = blobs(150, seed=4)
    side = np.where(y == 1, 1.0, -1.0)
    many, offset = kernels.solve(np.concatenate([x] * 8), np.concatenate([side] * 8), 1.0, 0.5, tolerance=1e-7)
    once, same = kernels.solve(x, side, np.full(150, 8.0), 0.5, tolerance=1e-7)
    assert np.abs(kernels.kernel(x, x, 0.5) @ (side * (many.reshape(8, 150).sum(axis=0) - once)) + offset - same).max() < 1e-3
    again, _ = kernels.solve(x, side, np.full(150, 8.0), 0.5, once, tolerance=1e-7)
    assert np.array_equal(once, again)
    model = kernels.KernelMachine(gamma=0.5, maxSupport=150).fit(frame(spark, np.concatenate([x] * 8), np.concatenate([y] * 8)))
    conditions(x, y, model, 0, 0, 1, 8.0, 0.5)
    assert model.support <= 150


@pytest.mark.parametrize("name, problem", [("Support Vector Machine (SVM)", CLASSIFICATION), ("Support Vector Regression (SVR)", REGRESSION)])
def test_rows_are_stored_as_given_and_expanded_where_they_are_summed(spark, name, problem, monkeypatch):
    stored, write = [], epsilon.shared_table
    monkeypatch.setattr(epsilon, "shared_table", lambda df, label: stored.append(write(df, label)) or stored[-1])
    kept = []
    monkeypatch.setattr(epsilon, "drop_table", lambda df: kept.append(df.agg(F.sum(F.length("x"))).first()[0]))
    x, y = blobs(300, 3)
    model = D.get_estimator(name, problem).fit(frame(spark, x, y))
    assert kept == [300 * 2 * 8] and len(stored) == 1
    assert D.model_size(model) == ({"models": 3} if problem == CLASSIFICATION else {"coefficients": 128})


@pytest.mark.parametrize("cells", [0, 10**7])
@pytest.mark.parametrize("classes", [2, 3])
def test_fourier_machine_is_near_its_bound(spark, classes, cells, tmp_path, monkeypatch):
    monkeypatch.setattr(epsilon, "BLOCK_ROWS", 64)
    monkeypatch.setattr(epsilon, "DIRECT_TASKS", 2)
    x, y = blobs(400, classes, 5)
    df = frame(spark, x, y).repartition(5)
    model = fourier.FourierMachine(classes=classes, C=0.5, gamma=0.4, width=2, components=40, taskCells=cells).fit(df)
    z = model._waves().of(x)
    margins = np.column_stack([z @ w[:-1] + w[-1] for w in model.models])
    for k, w in enumerate(model.models):
        side = np.where(y == (1 if classes == 2 else k), 1.0, -1.0)
        value = w[:-1] @ w[:-1] / 2 + 0.5 * np.maximum(1 - side * margins[:, k], 0).sum()
        bound = model.getOrDefault(model.bounds)[k]
        assert abs(value - model.getOrDefault(model.objectives)[k]) < 1e-9 * value and bound <= value <= bound * 1.002
    expected = (margins[:, 0] > 0) * 1.0 if classes == 2 else margins.argmax(axis=1)
    model.write().overwrite().save(str(tmp_path / "machine"))
    for scorer in (model, fourier.FourierModel.load(str(tmp_path / "machine"))):
        rows = scorer.transform(df).orderBy("id").select("prediction", vector_to_array("rawPrediction")).collect()
        assert [r[0] for r in rows] == expected.tolist()
        assert np.allclose([r[1] for r in rows], margins if classes == 3 else margins @ [[-1.0, 1.0]])


def test_cosines_of_blocks():
    z = np.random.default_rng(1).normal(0, 50, (700, 3))
    expected = np.cos(z)
    epsilon._cosines(z)
    assert np.abs(z - expected).max() < 1e-12


def test_one_class_only_and_places_of_sparse_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    places = [sorted(rng.choice(300, rng.integers(0, 4), replace=False).tolist()) for _ in range(200)]
    vectors = [Vectors.sparse(300, p, [float(i % 5 + 1) for i in p]) for p in places]
    y = [float(sum(p) % 2) for p in places]
    sparse = spark.createDataFrame(list(zip(vectors, y, strict=True)), ["features", "label"])
    mixed = spark.createDataFrame([(v if i % 3 else Vectors.dense(v.toArray()), b) for i, (v, b) in enumerate(zip(vectors, y, strict=True))], ["features", "label"])
    fits = []
    for df, wide in ((sparse, 256), (sparse, 1000), (mixed, 256)):
        monkeypatch.setattr(epsilon, "DENSE_WIDTH", wide)
        fits.append(fourier.FourierMachine(classes=2, gamma=0.01, width=300, components=20, gap=1e-6).fit(df))
    objectives = [m.getOrDefault(m.objectives)[0] for m in fits]
    assert max(objectives) <= min(objectives) * (1 + 2e-6)
    alone = fourier.FourierMachine(classes=2, gamma=0.01, width=300, components=20).fit(sparse.withColumn("label", F.lit(0.0)))
    assert alone.transform(sparse).filter("prediction != 0").count() == 0
