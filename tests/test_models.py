from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from checks import modelling
from tabkit.operators import knn as N
from tabkit.operators.target import CLASSIFICATION, REGRESSION
from tabkit.plans import features as X
from tabkit.plans import models as D
from tabkit.plans import score as A
from tabkit.plans import train as T
from tabkit.sources import registry
from tabkit.streaming import scoring as S


def vectors(spark, x, y):
    return spark.createDataFrame([(Vectors.dense(r), float(v)) for r, v in zip(x, y)], ["features", "label"])


@pytest.fixture(scope="module")
def linear():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    x = (x - x.mean(0)) / x.std(0)
    return x, x @ [3.0, -2.0, 0.0] + 5 + rng.normal(size=400)


def test_ridge_equals_the_closed_form(spark, linear):
    x, y = linear
    model = D.get_estimator("Ridge Regression", REGRESSION, alpha=50.0).fit(vectors(spark, x, y))
    expected = np.linalg.solve(x.T @ x + 50 * np.eye(3), x.T @ (y - y.mean()))
    assert np.allclose(model.coefficients, expected, atol=1e-6)


def test_lasso_equals_coordinate_descent(spark, linear):
    x, y = linear
    model = D.get_estimator("Lasso Regression", REGRESSION, alpha=0.3).fit(vectors(spark, x, y))
    w, r = np.zeros(3), y - y.mean()
    for _ in range(500):
        for j in range(3):
            rho = x[:, j] @ (r - x @ w + x[:, j] * w[j]) / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - 0.3, 0) / (x[:, j] @ x[:, j] / len(y))
    assert np.allclose(model.coefficients, w, atol=1e-4)


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_regression_minimises_the_usual_objective(spark, linear, classes):
    """At the minimum of C * loss + |w|^2 / 2 the gradient with respect to the weights is zero."""
    x, y = linear
    labels = np.digitize(y, np.quantile(y, np.linspace(0, 1, classes + 1)[1:-1]))
    model = D.get_estimator("Logistic Regression", CLASSIFICATION, C=0.5).fit(vectors(spark, x, labels))
    w, b = model.coefficientMatrix.toArray(), np.array(model.interceptVector.toArray())
    if classes == 2:
        p = 1 / (1 + np.exp(-(x @ w[0] + b[0])))
        gradient = 0.5 * x.T @ (p - labels) + w[0]
    else:
        z = x @ w.T + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        gradient = 0.5 * (p - np.eye(3)[labels]).T @ x + w
    assert np.abs(gradient).max() < 0.05


def test_unknown_models_are_none():
    assert D.get_estimator("Neural Networks", CLASSIFICATION) is None
    assert D.param_grid("Neural Networks", CLASSIFICATION) == {}


def test_grids_only_name_known_parameters():
    for (problem, name), grid in D.GRIDS.items():
        D.NamedEstimator(name, problem, **{k: v[0] for k, v in grid.items()})
    assert len(D.combinations(D.param_grid("XGBoost", REGRESSION))) == 81
    drawn = D.sample_combinations(D.param_grid("XGBoost", REGRESSION), 10)
    assert len(drawn) == 10 and len({tuple(c.items()) for c in drawn}) == 10


def test_unseen_and_missing_categories(spark):
    train = spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, "x"), (8.0, None)], "a double, t string")
    model = Pipeline(stages=X.feature_stages(train.withColumn("y", F.lit(1)), "y")).fit(train)
    out = model.transform(spark.createDataFrame([(None, "z"), (3.0, None), (3.0, "y")], "a double, t string"))
    assert X.feature_names(out) == ["num__a", "cat__t_x", "cat__t_y"]
    got = [list(r[0]) for r in out.select(vector_to_array("features")).collect()]
    assert got[0][1:] == [0.0, 0.0] and got[1][1:] == [1.0, 0.0] and got[2][1:] == [0.0, 1.0]
    filled = np.array([1, 3, 3, 8])
    assert got[0][0] == pytest.approx((3 - filled.mean()) / filled.std())


def test_too_many_categories_are_refused(spark):
    df = spark.range(300).select("id", F.col("id").cast("string").alias("t"))
    with pytest.raises(ValueError, match="more than 50 categories in t"):
        X.feature_stages(df, "id", max_categories=50)


def brute(queries, points, labels, k, metric):
    d = np.abs(queries[:, None] - points) if metric == "manhattan" else (queries[:, None] - points) ** 2
    d = d.sum(-1) if metric == "manhattan" else np.sqrt(d.sum(-1))
    found = []
    for row in d:
        order = np.lexsort((labels, row))[:k]
        found.append(list(zip(np.round(row[order], 9), labels[order])))
    return found


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("block_rows", [10_000, 37])
def test_neighbours_equal_brute_force(spark, metric, block_rows):
    """A third of the points are copies of one point and the rest is unevenly dense."""
    rng = np.random.default_rng(5)
    points = np.concatenate([np.full((300, 2), 1.5), rng.normal(0, 0.1, (400, 2)), rng.normal(0, 20, (200, 2))])
    labels = rng.integers(0, 3, len(points)).astype(float)
    queries = np.concatenate([rng.normal(0, 20, (60, 2)), rng.normal(0, 0.2, (60, 2)), [[1.5, 1.5]]])
    q = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(queries)], "qid long, vec array<double>")
    p = spark.createDataFrame([([float(a) for a in v], float(l)) for v, l in zip(points, labels)], "vec array<double>, label double")
    got = {i: [] for i in range(len(queries))}
    for r in N.nearest_neighbours(q, p, 7, metric, block_rows=block_rows).orderBy("qid", "dist", "label").collect():
        got[r["qid"]] += [(round(r["dist"], 9), r["label"])] * r["w"]
    expected = brute(queries, points, labels, 7, metric)
    assert [got[i] for i in range(len(queries))] == expected


def test_visited_blocks_do_not_grow_with_clustered_points(spark):
    """Sixteen times the points, a few more blocks per query."""
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 100, (40, 3))
    visited, searched = [], []
    for n in (1000, 16_000):
        x = centres[rng.integers(0, 40, n)] + rng.normal(0, 1, (n, 3))
        p = spark.createDataFrame([([float(a) for a in v], 0.0) for v in x], "vec array<double>, label double")
        q = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(centres)], "qid long, vec array<double>")
        index = N.CellIndex.build(p, block_rows=50)
        near = index.visits(q, 5)
        bound = index.search(q, 5).groupBy("qid").agg(F.max("dist").alias("theta"))
        rest = index.further(near.join(bound, "qid"))
        blocks = near.union(rest).select(F.explode("blocks")).count()
        visited.append(blocks / 40)
        searched.append(blocks / 40 * n / len(index.blocks))
        assert len(index.blocks) >= n / 100
    assert visited[1] < 6 * visited[0] and searched[1] < 8 * searched[0] and searched[1] < 16_000 / 10


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_projections_reach_a_recall_of_nine_tenths(spark, metric):
    rng = np.random.default_rng(7)
    points = np.concatenate([np.full((300, 6), 0.5), rng.normal(0, 1, (3000, 6)) * [5, 3, 2, 1, 0.2, 0.1]])
    labels = rng.integers(0, 3, len(points)).astype(float)
    queries = np.concatenate([points[-150:] + rng.normal(0, 0.1, (150, 6)), [[0.5] * 6]])
    q = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(queries)], "qid long, vec array<double>")
    p = spark.createDataFrame([([float(a) for a in v], float(l)) for v, l in zip(points, labels)], "vec array<double>, label double")
    got = {i: [] for i in range(len(queries))}
    for r in N.nearest_neighbours(q, p, 7, metric, method="projections", block_rows=100).collect():
        got[r["qid"]] += [(round(r["dist"], 9), r["label"])] * r["w"]
    expected = brute(queries, points, labels, 7, metric)
    hits = sum(sum((Counter(e) & Counter(got[i])).values()) for i, e in enumerate(expected))
    assert hits / (7 * len(queries)) >= 0.9
    assert all(len(g) <= 7 for g in got.values()) and len(got[len(queries) - 1]) == 7


def test_vote_shares_are_probabilities(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(3, 1, (60, 2)), rng.normal([0, 5], 1, (60, 2))]).round(1)
    rows = [(i, [float(a) for a in v], float(i // 60)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [rows[3]], "id long, x array<double>, label double").withColumn("features", array_to_vector("x"))
    model = D.get_estimator("K-Nearest Neighbors (KNN)", CLASSIFICATION, n_neighbors=4).fit(df)
    scored = model.transform(df).select("id", "prediction", vector_to_array("probability").alias("p")).collect()
    assert len(scored) == 181
    for r in scored:
        assert abs(sum(r["p"]) - 1) < 1e-12 and {round(4 * v, 9) % 1 for v in r["p"]} == {0.0} and r["p"].index(max(r["p"])) == r["prediction"]
    model.write().overwrite().save(str(tmp_path / "knn"))
    again = D.KnnModel.load(str(tmp_path / "knn")).transform(df).select("id", "prediction")
    assert sorted(map(tuple, again.collect())) == sorted((r["id"], r["prediction"]) for r in scored)


def test_fewer_points_than_neighbours(spark):
    q = spark.createDataFrame([(1, [0.0])], "qid long, vec array<double>")
    p = spark.createDataFrame([([1.0], 2.0), ([3.0], 0.0)], "vec array<double>, label double")
    assert N.nearest_neighbours(q, p, 5).count() == 2
    with pytest.raises(ValueError, match="no training points"):
        N.nearest_neighbours(q, p.where("label = 9"), 5)


@pytest.fixture(scope="module")
def training(table):
    rows = table("orders").withColumn("large", F.col("o_totalprice") > 250000).withColumn("half", F.col("o_totalprice") / 2 + F.col("o_custkey"))
    return T.train(
        rows.drop("o_totalprice", "o_orderdate"), "large", "o_orderkey",
        ["Logistic Regression", "Decision Tree", "K-Nearest Neighbors (KNN)"],
        params={"Decision Tree": {"max_depth": 4}}, folds=3,
    )


def test_training_learns_and_reports(training):
    runs = {r["model"]: r for r in training.runs.collect()}
    assert len(runs) == 3
    assert runs["Decision Tree"]["metrics"]["accuracy"] > 0.95
    for r in runs.values():
        assert len(r["cv_scores"]) == 3
        assert r["cv_mean"] == pytest.approx(np.mean(r["cv_scores"])) and r["cv_std"] == pytest.approx(np.std(r["cv_scores"]))
    top = T.feature_importance(training.models["Decision Tree"], training.test).first()
    assert top["feature"] == "num__half"
    assert training.train.join(training.test, "o_orderkey").count() == 0


def test_held_out_rows_do_not_shape_the_features(spark):
    """One huge value sits in one fold; only the scaling of the other folds may know it."""
    df = spark.range(60).select("id", F.when(F.col("id") == 7, 1e6).otherwise(F.col("id").cast("double")).alias("x"), F.col("id").cast("double").alias("label"))
    folded = df.withColumn("fold", (F.col("id") % 3).cast("int"))
    seen = []

    class Spy:
        def fit(self, rows):
            seen.append(rows.select(F.max(vector_to_array("features")[0])).first()[0])
            return D.get_estimator("Linear Regression", REGRESSION).fit(rows)

    T.fold_scores([Spy()], X.feature_stages(df, "label", ["id"]), folded, 3, REGRESSION)
    assert seen[1] < 2 < seen[0] and seen[2] > 2


@pytest.mark.parametrize("name", ["Logistic Regression", "Decision Tree", "K-Nearest Neighbors (KNN)"])
def test_saved_models_predict_the_same(spark, training, tmp_path, name):
    model = training.models[name]
    model_id = registry.save_model(spark, model, str(tmp_path))
    assert registry.list_models(spark, str(tmp_path)).first()["model_name"] == name
    back = registry.load_model(spark, str(tmp_path), model_id)
    rows = training.test.drop("label", "large")
    a, b = (A.score(m, rows).orderBy("o_orderkey").collect() for m in (model, back))
    assert a == b and set(r["prediction"] for r in a) <= {"true", "false"}


def test_scoring_reports_missing_columns_and_keeps_others(spark, training):
    rows = training.test.drop("label", "large")
    model = training.models["Logistic Regression"]
    with pytest.raises(ValueError, match="half"):
        A.score(model, rows.drop("half"))
    out = A.score(model, rows.withColumn("note", F.lit("kept")).withColumn("half", F.lit("not a number")))
    assert out.columns == [*rows.columns, "note", "prediction", "prob_class_false", "prob_class_true"]
    assert out.first()["half"] is None
    assert A.score(model, A.default_row(training.train, "large")).count() == 1


def test_stream_scores_like_batch_without_state(spark, training, tmp_path):
    rows = training.test.drop("label", "large")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    model = training.models["Logistic Regression"]
    stream = S.read_stream(spark, str(tmp_path / "in"), rows.schema, max_files=1)
    scored = S.score_stream(model, stream)
    assert scored.isStreaming
    query = S.write_scored(scored, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
    query.awaitTermination()
    assert not any(p["stateOperators"] for p in query.recentProgress)
    batch = A.score(model, rows)
    got = spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))
    assert sorted(got.collect()) == sorted(batch.collect())
    with pytest.raises(ValueError, match="nearest neighbours cannot score a stream"):
        S.score_stream(training.models["K-Nearest Neighbors (KNN)"], stream)


def test_search_ranks_real_scores(table):
    rows = table("part").withColumn("y", F.col("p_retailprice") * 2 + F.col("p_size")).select("p_partkey", "p_retailprice", "p_size", "y")
    found = T.search(rows, "y", "p_partkey", "Decision Tree", REGRESSION, folds=3, grid={"max_depth": [1, 6], "min_samples_leaf": [1]}).collect()
    assert [r["params"]["max_depth"] for r in found] == ["6", "1"]
    assert found[0]["cv_mean"] > found[1]["cv_mean"]
    with pytest.raises(ValueError):
        T.search(rows, "y", "p_partkey", "Decision Tree", REGRESSION, folds=2)


def test_fourier_features_approximate_the_kernel(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 4))
    df = spark.createDataFrame([([float(a) for a in r],) for r in x], "v array<double>").select(array_to_vector("v").alias("features"))
    stage = D.FourierFeatures()._set(gamma=0.3, width=4, components=4096)
    z = np.array([r[0] for r in stage.transform(df).select(vector_to_array("fourier")).collect()])
    expected = np.exp(-0.3 * ((x[:, None] - x) ** 2).sum(-1))
    assert np.abs(z @ z.T - expected).max() < 0.12


@pytest.mark.parametrize("query", [
    "decision_tree", "random_forest", "boosted_trees", "random_forest_regression", "boosted_trees_regression",
    "decision_tree_regression", "feature_importance", "train_models", "model_sizes",
])
def test_queries_train_with_defaults_on_all_columns(spark, monkeypatch, query):
    calls = []

    def train(df, target, key, models, *args, params=None, **rest):
        calls.append((set(df.columns), params))
        raise InterruptedError

    monkeypatch.setattr(modelling.T, "train", train)
    with pytest.raises(InterruptedError):
        modelling.CHECKS[query][0](spark, "/root/testdata/sf0.001")
    (columns, params), = calls
    assert not any((params or {}).values())
    part, orders = {"p_name", "p_brand", "p_type", "p_size"}, {"o_custkey", "o_orderdate", "o_orderpriority"}
    assert part <= columns or orders <= columns


def test_cross_validate_scores_every_fold(table):
    rows = table("orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") * 2 + F.col("o_orderkey") % 7).alias("y"))
    labelled, _ = T.with_label(rows, "y", REGRESSION)
    stages = X.feature_stages(labelled, "y", ["o_orderkey", "label"])
    found = T.cross_validate(D.get_estimator("Linear Regression", REGRESSION), stages, labelled, "o_orderkey", REGRESSION, k=3)
    assert len(found["cv_scores"]) == 3 and min(found["cv_scores"]) > 0.999
    assert found["cv_mean"] == pytest.approx(np.mean(found["cv_scores"])) and found["cv_std"] == pytest.approx(np.std(found["cv_scores"]))


@pytest.mark.parametrize("metric, size", [("euclidean", 3), ("manhattan", 3), ("euclidean", 40)])
def test_few_points_of_a_block_are_measured(monkeypatch, metric, size):
    """The nearest of a block, with copies and ties, from few measured distances."""
    rng = np.random.default_rng(9)
    points = np.concatenate([rng.normal(0, 3, (3000, size)), np.ones((90, size)), np.round(rng.normal(0, 1, (400, size)))])
    queries = np.concatenate([rng.normal(0, 3, (70, size)), np.ones((3, size)), np.full((2, size), 50.0)])
    labels = rng.integers(0, 3, len(points)).astype(float)
    p = pd.DataFrame({"pid": np.arange(len(points)), "vec": list(points), "label": labels, "w": np.ones(len(points), np.int64)})
    q = pd.DataFrame({"qid": np.arange(len(queries)), "vec": list(queries)})
    measured, plainly = [], N._distances
    monkeypatch.setattr(N, "_distances", lambda a, b, m: measured.append(len(a) * len(b)) or plainly(a, b, m))
    got = N._best(q, p, 7, metric)
    assert sum(measured) < len(points) * len(queries) / 3
    expected = brute(queries, points, labels, 7, metric)
    for i, rows in got.groupby("qid"):
        assert list(zip(rows["dist"].round(9), rows["label"])) == expected[i]
    assert set(got["qid"]) == set(range(len(queries)))


def test_blocks_name_no_points_beyond_the_bound():
    """A query that has its bound gets from a further block what is as near, and may get nothing."""
    for size in (2, 20):
        points = pd.DataFrame({"pid": range(100), "vec": [np.full(size, float(i)) for i in range(100)], "label": 0.0, "w": 1})
        queries = pd.DataFrame({"qid": [1, 2, 3], "vec": [np.zeros(size), np.full(size, 500.0), np.full(size, -9.0)], "theta": [2 * size**0.5, 1.0, np.inf]})
        got = N._best(queries, points, 5, "euclidean")
        assert got.groupby("qid")["pid"].apply(list).to_dict() == {1: [0, 1, 2], 3: [0, 1, 2, 3, 4]}


@pytest.mark.parametrize("metric, size", [("euclidean", 3), ("manhattan", 2), ("euclidean", 20)])
def test_leaves_beyond_the_first_are_searched_and_equal_queries_once(spark, tmp_path, monkeypatch, metric, size):
    monkeypatch.setattr(N, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(11)
    points = np.concatenate([np.full((120, size), 1.5), rng.normal(0, 1, (500, size)), rng.integers(0, 2, (200, size)).astype(float)])
    labels = rng.integers(0, 3, len(points)).astype(float)
    queries = np.concatenate([np.repeat(rng.normal(0, 3, (30, size)), 4, axis=0), rng.normal(0, 1, (60, size)), np.full((2, size), 1.5)])
    q = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(queries)], "qid long, vec array<double>")
    p = spark.createDataFrame([([float(a) for a in v], float(l)) for v, l in zip(points, labels)], "vec array<double>, label double")
    expected, stored, write = brute(queries, points, labels, 7, metric), {}, N.shared_table
    monkeypatch.setattr(N, "shared_table", lambda df, label: stored.setdefault(label, write(df, label)) if label != "knn-load" else write(df, label))

    def answers(found):
        got = {i: [] for i in range(len(queries))}
        for r in found.orderBy("qid", "dist", "label").collect():
            got[r["qid"]] += [(round(r["dist"], 9), r["label"])] * r["w"]
        return [got[i] for i in range(len(queries))]

    assert answers(N.nearest_neighbours(q, p, 7, metric, block_rows=20)) == expected
    assert stored["knn-visits"].count() == 91 and stored["knn-rest"].count() > 0
    monkeypatch.setattr(N, "shared_table", write)
    index = N.CellIndex.build(p, metric, block_rows=20)
    index.save(str(tmp_path / "index"))
    assert answers(N.CellIndex.load(spark, str(tmp_path / "index"), metric).search(q, 7)) == expected


def test_a_query_looks_at_few_of_many_leaves(monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(20_000, 2))
    tree = N.TreeIndex(None, np.empty((0, 2)), pd.DataFrame(), "euclidean", 20)
    tree._split(x, 20, 200)
    leaf = tree.leaf(x)
    rows = pd.DataFrame({"block": leaf, "row": range(len(x))}).groupby("block")["row"].apply(lambda r: r.to_numpy())
    tree.blocks = pd.DataFrame({"block": rows.index, "w": rows.map(len), "low": [x[r].min(axis=0) for r in rows], "high": [x[r].max(axis=0) for r in rows]})
    tree._bounds()
    assert tree.weight[0] == len(x) and ((tree.start[leaf] <= x) & (x <= tree.end[leaf])).all() and len(rows) > 1000
    looked, gap = [], tree._gap
    monkeypatch.setattr(tree, "_gap", lambda v, node: looked.append(len(v)) or gap(v, node))
    queries, reach = rng.normal(size=(500, 2)), np.full(500, 0.02)
    got = set(zip(*(part.tolist() for part in tree.within(queries, reach))))
    assert sum(looked) < 500 * len(rows) / 10
    assert got == {(i, int(b)) for b in rows.index for i in np.flatnonzero(gap(queries, b) <= reach)}


def test_entries_that_are_all_the_same_are_not_measured(monkeypatch):
    rng = np.random.default_rng(13)
    points, queries = np.zeros((500, 6)), np.zeros((40, 6))
    points[:, 1], queries[:, 1], points[:, 4], queries[:, 4] = rng.normal(size=500), rng.normal(size=40), 3.0, 3.0
    widths, plainly = [], N._distances
    monkeypatch.setattr(N, "_distances", lambda a, b, m: widths.append(a.shape[1]) or plainly(a, b, m))
    p = pd.DataFrame({"pid": np.arange(500), "vec": list(points), "label": 0.0, "w": np.ones(500, np.int64)})
    for moved, width in ((0.0, 1), (1.0, 2)):
        widths.clear()
        queries[:, 2] = moved
        got = N._best(pd.DataFrame({"qid": np.arange(40), "vec": list(queries)}), p, 5, "euclidean")
        assert set(widths) == {width}
        assert [list(zip(r["dist"].round(9), r["label"])) for _, r in got.groupby("qid")] == brute(queries, points, np.zeros(500), 5, "euclidean")
    same = N._best(pd.DataFrame({"qid": [1], "vec": [points[0]]}), p.assign(vec=[points[0]] * 500), 5, "euclidean")
    assert same["dist"].tolist() == [0.0] * 5
