"""Folds, candidate sampling and a tiny end-to-end fit."""

import math

import pytest

from pyspark.sql import functions as F

from trialspark.plans import folds as FO
from trialspark.plans import model as MD


def test_leave_one_year_out_folds(spark):
    df = spark.createDataFrame([(y, float(i)) for i, y in enumerate([2021, 2019, 2019, 2023, 2021])],
                               "Year int, y double")
    got = sorted((r["Year"], r["fold"]) for r in FO.leave_one_group_out(df).collect())
    assert got == [(2019, 0), (2019, 0), (2021, 1), (2021, 1), (2023, 2)]


def test_contiguous_folds_sizes_like_kfold(spark):
    df = spark.range(0, 23).select(F.col("id").alias("k"))
    got = sorted((r["k"], r["fold"]) for r in FO.contiguous_folds(df, ["k"], 5).collect())
    sizes = [sum(1 for _, f in got if f == i) for i in range(5)]
    assert sizes == [5, 5, 5, 4, 4]
    # contiguous: fold ids never decrease along the order
    assert [f for _, f in got] == sorted(f for _, f in got)


def test_mean_model_cv(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "fold int, y double")
    got = {r["fold"]: r["mse"] for r in FO.mean_model_cv(df, "y").collect()}
    assert got == {0: ((1 - 5) ** 2 + (3 - 5) ** 2) / 2, 1: (5 - 2) ** 2}


def test_candidates_are_seeded_and_in_range():
    a = MD.sample_candidates(MD.BOOSTED_SPACE, 20)
    b = MD.sample_candidates(MD.BOOSTED_SPACE, 20)
    assert a == b
    for c in a:
        for k, (lo, hi, _) in MD.BOOSTED_SPACE.items():
            assert lo <= c[k] <= hi
        assert isinstance(c["n_estimators"], int) and isinstance(c["max_depth"], int)
    # log-uniform draws spread over orders of magnitude
    lr = [c["learning_rate"] for c in MD.sample_candidates(MD.BOOSTED_SPACE, 200)]
    assert min(lr) < 0.02 and max(lr) > 0.1 and all(not math.isnan(x) for x in lr)


def test_every_candidate_runs_as_drawn():
    for kind, space in (("boosted", MD.BOOSTED_SPACE), ("forest", MD.LEAF_WISE_SPACE)):
        est = MD.make_estimator(kind)
        trees = est.maxIter if kind == "boosted" else est.numTrees
        for c in MD.sample_candidates(space, 20):
            p = MD.spark_params(est, c)
            assert p[trees] == c["n_estimators"] and p[est.maxDepth] == c["max_depth"]
    with pytest.raises(ValueError):
        MD.spark_params(est, {"max_depth": 31})


def test_test_rows_are_not_in_train(spark):
    from trialspark.plans import catalog as C
    from tests.conftest import SF_SMALL

    train = C.train_wide(spark, SF_SMALL, None).select("Env", "Hybrid")
    test = C.test_wide(spark, SF_SMALL, None).select("Env", "Hybrid")
    assert test.count() > 0 and test.join(train, ["Env", "Hybrid"]).count() == 0


def test_tiny_fit_and_predict(spark):
    rows = [(f"H{i % 4}", 2019 + i % 3, f"L_{2019 + i % 3}", f"H{i % 4}_L", float(i % 4) * 2 + (i % 3),
             float(i % 4), None if i % 5 == 0 else float(i % 3)) for i in range(60)]
    train = spark.createDataFrame(rows, "Hybrid string, Year int, Env string, Hybrid_Env string, "
                                        "Yield_Mg_ha double, a double, b double")
    train = MD.loyo(train)
    test = spark.createDataFrame([("H1", 2024, "L_2024", "H1_L", None, 1.0, None)],
                                 "Hybrid string, Year int, Env string, Hybrid_Field string, "
                                 "Yield_Mg_ha double, a double, c double")
    keys = ["Hybrid", "Year", "Env", "Hybrid_Env", "Yield_Mg_ha", "fold"]
    data = MD.prepare(train, test, keys, ["Hybrid", "Year", "Env", "Hybrid_Field", "Yield_Mg_ha"])
    space = dict(MD.BOOSTED_SPACE, n_estimators=(2, 3, "log-uniform"), max_depth=(2, 3, "log-uniform"))
    model, scores = MD.search_and_fit(data, space, "boosted", MD.Budget(n_iter=2, parallelism=1))
    assert len(scores) == 2 and all(s >= 0 for s in scores)
    pred = MD.predict(model, data.test).collect()
    assert len(pred) == 1 and pred[0]["Yield_Mg_ha"] is not None
