import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabkit.functions.quantiles import quantiles
from tabkit.functions.ranking import hash_cutoffs, row_hash, running_totals, with_position

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(0)
    n = 20000
    heavy = np.where(rng.random(n) < 0.4, 7.0, rng.exponential(50, n))
    wide = np.exp(rng.normal(0, 20, n)) * rng.choice([-1, 1], n)
    const = np.full(n, 3.0)
    rows = [
        (float(a), None if i % 5 == 0 else float(b), float(c), int(i), None)
        for i, (a, b, c) in enumerate(zip(heavy, wide, const))
    ]
    return spark.createDataFrame(rows, "heavy double, wide double, const double, k long, none double").cache()


@pytest.mark.parametrize("limits", [dict(), dict(sample_rows=500, accuracy=50, ranked_rows=300), dict(accuracy=50, ranked_rows=0)])
def test_quantiles_match_numpy(mixed, limits):
    got = quantiles(mixed, mixed.columns, PROBS, **limits)
    pdf = mixed.toPandas()
    for c in ["heavy", "wide", "const", "k"]:
        expected = np.quantile(pdf[c].dropna().astype(float), PROBS)
        assert np.allclose(got[c], expected, rtol=1e-12), c
    assert got["none"] == [None] * len(PROBS)


@pytest.mark.parametrize("limits", [dict(), dict(accuracy=20, ranked_rows=1)])
def test_quantiles_with_infinities(spark, limits):
    values = [float("-inf")] * 30 + [float(i) for i in range(40)] + [float("inf")] * 30 + [float("nan"), None]
    got = quantiles(spark.createDataFrame([(v,) for v in values], "v double"), ["v"], [0.0, 0.1, 0.5, 0.9, 1.0], **limits)
    assert got["v"] == [float("-inf"), float("-inf"), 19.5, float("inf"), float("inf")]


def test_large_tables_are_read_three_times_at_most(mixed, monkeypatch):
    from tabkit.functions import quantiles as engine

    calls = []
    for name in ("_recount", "_rank", "_cut_points"):
        real = getattr(engine, name)
        monkeypatch.setattr(engine, name, lambda *a, real=real, name=name: (calls.append(name), real(*a))[1])
    quantiles(mixed, mixed.columns, PROBS, ranked_rows=5000)
    assert calls == ["_recount", "_rank"]


def test_hash_cutoffs_pick_exact_ranks(mixed):
    df = mixed.select("k", F.when(F.col("k") % 3 == 0, "a").when(F.col("k") % 7 == 0, None).otherwise("b").alias("g"))
    hashed = df.select("g", row_hash(["k"], 42).alias("h"))
    cut = hash_cutoffs(hashed, ["g"], lambda n: [F.round(n * 0.2), F.round(n * 0.5), F.lit(0)], 10**9)
    cut = {r["g"]: r for r in cut.collect()}
    window = Window.partitionBy("g").orderBy("h")
    ranked = hashed.withColumn("rn", F.row_number().over(window)).toPandas()
    for g in ["a", "b", None]:
        mine = ranked[ranked["g"].isna()] if g is None else ranked[ranked["g"] == g]
        n = len(mine)
        for j, rank in enumerate([int(n * 0.2 + 0.5), int(n * 0.5 + 0.5)]):
            assert mine.loc[mine["rn"] == rank, "h"].item() == cut[g][f"t{j}"]
        assert cut[g]["t2"] is None


@pytest.mark.parametrize("limit", [10**6, 100])
def test_positions_follow_the_order(mixed, limit):
    distinct = mixed.select("heavy").distinct()
    got = with_position(distinct, ["heavy"], "pos", one_task_rows=limit).toPandas().sort_values("heavy")
    assert got["pos"].tolist() == list(range(len(got)))


@pytest.mark.parametrize("limit", [10**6, 100])
def test_running_totals(mixed, limit):
    per_value = mixed.groupBy("heavy").agg(F.count("*").alias("n"))
    out = running_totals(per_value, "heavy", {"n": "upto"}, {"n": "before"}, one_task_rows=limit)
    got = out.toPandas().sort_values("heavy", ascending=False)
    assert got["upto"].tolist() == got["n"].cumsum().tolist()
    assert (got["upto"] - got["n"]).tolist() == got["before"].tolist()


def test_many_equal_scores_are_ranked_in_slices(spark, monkeypatch):
    """Ties are cut by the tie columns: no slice holds more than its share."""
    from tabkit.functions import ranking
    sizes = []
    stored = ranking.cut_lineage

    def seen(df):
        out = stored(df)
        sizes.append([r["count"] for r in out.groupBy("_slice").count().collect()])
        return out

    monkeypatch.setattr(ranking, "cut_lineage", seen)
    df = spark.range(0, 60_000, 1, 8).select((F.col("id") % 2).alias("g"), F.lit(1.0).alias("s"), "id")
    got = ranking.rank_within(df, ["g"], "s", ["id"], "r", one_task_rows=1000)
    assert got.filter("r != floor(id / 2) + 1").count() == 0
    assert len(sizes[0]) > 60 and max(sizes[0]) < 3000


@pytest.mark.parametrize("limit", [1, 10**6])
def test_slices_of_one_row_give_the_same_order(spark, limit):
    df = spark.createDataFrame([(g, s, t) for g in "ab" for s in (None, 1.0, 1.0, 2.0) for t in range(3)], "g string, s double, t int").dropDuplicates()
    from tabkit.functions.ranking import rank_within
    got = sorted(tuple(r) for r in rank_within(df, ["g"], "s", ["t"], "r", one_task_rows=limit).select("g", "r", "s", "t").collect())
    assert [r[1] for r in got] == list(range(1, 10)) * 2
    assert [r[2] for r in got[:9]] == [2.0] * 3 + [1.0] * 3 + [None] * 3
