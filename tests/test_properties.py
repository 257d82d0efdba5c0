"""Property tests (few examples each: every example runs Spark jobs)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialspark.operators import ensemble as EN
from trialspark.plans import folds as FO

SETTINGS = settings(max_examples=6, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(n=st.integers(min_value=5, max_value=400), k=st.integers(min_value=2, max_value=7))
def test_contiguous_folds_partition_rows(spark, n, k):
    df = spark.range(0, n).select(((F.col("id") * 7919) % n).alias("key"))
    got = sorted((r["key"], r["fold"]) for r in FO.contiguous_folds(df, ["key"], k).collect())
    assert [key for key, _ in got] == list(range(n))          # every row exactly once
    sizes = [sum(1 for _, f in got if f == i) for i in range(k)]
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    assert [f for _, f in got] == sorted(f for _, f in got)  # contiguous in key order


@SETTINGS
@given(weights=st.lists(st.floats(min_value=0.1, max_value=50), min_size=2, max_size=4),
       value=st.floats(min_value=-100, max_value=100))
def test_weighted_ensemble_weights_sum_to_one(spark, weights, value):
    names = [f"c{i}" for i in range(len(weights))]
    preds = {n: spark.createDataFrame([("E", "H", float(value))],
                                      "Env string, Hybrid string, Yield_Mg_ha double") for n in names}
    w = spark.createDataFrame(list(zip(names, weights)), "component string, V double")
    got = EN.weighted_ensemble(preds, w).first()["Yield_Mg_ha"]
    assert abs(got - value) <= 1e-9 * max(1.0, abs(value))


@SETTINGS
@given(years=st.lists(st.integers(min_value=2014, max_value=2023), min_size=3, max_size=40))
def test_leave_one_year_out_never_splits_a_year(spark, years):
    df = spark.createDataFrame([(y, i) for i, y in enumerate(years)], "Year int, i int")
    got = [(r["Year"], r["fold"]) for r in FO.leave_one_group_out(df).collect()]
    by_year = {}
    for y, f in got:
        by_year.setdefault(y, set()).add(f)
    assert all(len(fs) == 1 for fs in by_year.values())
    assert sorted({f for fs in by_year.values() for f in fs}) == list(range(len(set(years))))
