"""Exact search against brute force in Python integers."""

import math

import numpy as np
import pytest

from trialspark.llm import threshold_topk as T


def brute(rows, queries, k=5, scale=256.0):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, v in queries:
        for j, w in ok:
            if i == j:
                asked[i] = min(asked.get(i, w), w)
    for q, qv in asked.items():
        s = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(qv, w)))), j) for j, w in ok if j != q)[:k]
        out += [(q, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as id")
    return sorted(tuple(r) for r in T.top_k(df, df.filter("vec_id % 3 = 0"), **kw).collect())


@pytest.mark.parametrize("n_lists", [1, 3, 4, 9])
def test_random_vectors(spark, n_lists):
    rng = np.random.default_rng(n_lists)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(150)]
    assert found(spark, rows, n_lists=n_lists) == brute(rows, [r for r in rows if r[0] % 3 == 0])


def test_ties_bad_rows_and_few_candidates(spark):
    rows = [(i, [1.0, 0.5]) for i in range(40)] + [(50, None), (51, [None, 1.0]), (54, [float("nan"), 1.0]),
                                                   (57, [float("inf"), 1.0]), (None, [9.0, 9.0]), (60, []), (61, [2.0]),
                                                   (63, [0.0, 0.0, 7.0]), (5, [3.0, 3.0])]
    assert found(spark, rows) == brute(rows, [r for r in rows if r[0] is not None and r[0] % 3 == 0])
    few = [(0, [1.0]), (1, [-0.001]), (3, [2.0])]
    assert found(spark, few) == brute(few, [few[0], few[2]])


def test_large_values_stay_exact(spark):
    rows = [(i, [1e9 + i, -1e9 + 3 * i, 1e8]) for i in range(12)] + [(20, [1e30, 1.0, 1.0]), (21, [-1e30, 0.0, 0.0])]
    assert found(spark, rows) == brute(rows, [r for r in rows if r[0] % 3 == 0])


def test_slices_and_empty(spark, monkeypatch):
    monkeypatch.setattr(T, "QUERY_SLICE", 20)
    monkeypatch.setattr(T, "QUERIES_AT_ONCE", 7)
    monkeypatch.setattr(T, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 256]) for i in range(120)]
    assert found(spark, rows) == brute(rows, [r for r in rows if r[0] % 3 == 0])
    assert found(spark, rows[:0]) == []
