"""Feature pipelines of all folds at once against one fit per fold."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from tabkit.plans import folds
from tabkit.plans.features import FEATURES, feature_stages


def table_of(spark, n=700, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        rows.append((
            i, float(rng.normal(1e6, 3)) if rng.random() > 0.1 else None, float(rng.integers(0, 4)), None if i % 50 else float("inf"),
            [None, "a", "b", "é", "Z", "rare" if i == 7 else "a"][rng.integers(0, 6)], None, bool(i % 2), int(rng.integers(0, 4)) if i != 7 else 2,
        ))
    return spark.createDataFrame(rows, "id long, x double, few double, odd double, s string, none string, flag boolean, fold int")


def columns_of(model, df):
    return [(r["id"], r["v"]) for r in model.transform(df).select("id", vector_to_array(FEATURES).alias("v")).orderBy("id").collect()]


@pytest.mark.parametrize("ranked", [10**6, 0])
def test_equal_to_a_fit_per_fold(spark, ranked):
    df = table_of(spark).persist()
    plain = df.drop("fold")
    stages = feature_stages(plain.drop("odd"), "id")
    found = folds.fold_pipelines(stages, df.drop("odd"), 4, ranked_rows=ranked)
    for f in range(4):
        one = Pipeline(stages=list(stages)).fit(df.drop("odd").where(F.col("fold") != f))
        a, b = found[f].stages[0], one.stages[0]
        assert a.get("medians") == b.get("medians") and a.get("fills") == b.get("fills")
        assert np.allclose(a.get("means"), b.get("means"), rtol=1e-12) and np.allclose(a.get("scales"), b.get("scales"), rtol=1e-9)
        x, y = columns_of(found[f], df), columns_of(one, df)
        assert [i for i, _ in x] == [i for i, _ in y] and np.allclose([v for _, v in x], [v for _, v in y], rtol=1e-9, atol=1e-8)
    df.unpersist()


def test_four_passes_serve_all_folds(spark):
    base = table_of(spark, 400).drop("odd").repartition(2).persist()
    base.count()
    for k in (2, 8):
        read = spark.sparkContext.accumulator(0)

        def counted(batches, read=read):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        df = base.withColumn("fold", (F.col("id") % k).cast("int")).mapInArrow(counted, base.schema)
        stages = feature_stages(base.drop("fold"), "id")
        before = read.value
        folds.fold_pipelines(stages, df, k)
        assert (read.value - before) / 400 <= 5
    base.unpersist()


def test_moments_merge():
    rng = np.random.default_rng(1)
    parts = [rng.normal(1e8, 2, n) for n in (3, 0, 50, 1)]
    n, mean, variance = folds.merged_moments([(len(p), p.mean() if len(p) else 0.0, p.var() if len(p) else 0.0) for p in parts])
    whole = np.concatenate(parts)
    assert n == 54 and abs(mean - whole.mean()) < 1e-6 and abs(variance - whole.var()) < 1e-6
    assert folds.merged_moments([]) == (0, 0.0, 0.0)


def test_a_fold_without_rows_and_columns_without_values(spark):
    df = spark.createDataFrame([(1, None, None, 0), (2, None, None, 0), (3, 5.0, "t", 2)], "id long, x double, s string, fold int")
    stages = feature_stages(df.drop("fold"), "id")
    found = folds.fold_pipelines(stages, df, 3)
    assert found[2].stages[0].get("medians") == [0.0] and found[2].stages[0].get("fills") == ["Unknown"]
    assert found[1].stages[0].get("medians") == [5.0] and found[1].stages[0].get("fills") == ["t"]
    assert len(columns_of(found[2], df)) == 3
