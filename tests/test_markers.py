"""Marker blocks, relationship products and variance components against dense numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import genotype as G
from trialspark.operators import markers as MK
from trialspark.operators import variance as VC
from trialspark.plans import matrices as MX


def made(n=200, m=37, seed=5, missing=0.1):
    rng = np.random.default_rng(seed)
    x = rng.binomial(2, rng.uniform(0.1, 0.9, m), (n, m)).astype(float)
    x[rng.random((n, m)) < missing] = np.nan
    return x


def frame(spark, x, parts=3):
    rows = [(f"H{i}", [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "Hybrid string, dosage array<double>").repartition(parts)


def codings(x):
    """Additive and dominance codings and their divisors, of a matrix without missing values."""
    n = len(x)
    p0, p2 = ((2 * (x == a).sum(0) + (x == 1).sum(0)) / (2 * n) for a in (0, 2))
    w = np.where(x == 0, -2 * p2 ** 2, np.where(x == 1, 2 * p2 * (1 - p2), np.where(x == 2, -2 * (1 - p2) ** 2, 0.0)))
    return x - 2 * p2, w, (2 * p0 * p2).sum(), ((2 * p2 * (1 - p2)) ** 2).sum()


@pytest.mark.parametrize("size", [5, 4096])
def test_block_statistics(spark, size):
    x = made()
    odd = spark.createDataFrame([("a", None), ("b", []), ("c", [2.0] * 40)], "Hybrid string, dosage array<double>")
    stats = MK.block_stats(frame(spark, x).unionByName(odd), size=size)
    got = {r.i: r for r in MK.per_marker(stats, size, **{c: (lambda s, c=c: s[c]) for c in MK.STATS}).collect()}
    assert sorted(got) == list(range(40))
    for i, r in got.items():
        v = np.append(x[:, i], 2.0) if i < 37 else np.array([2.0])
        v = v[~np.isnan(v)]
        assert (r.n, r.n0, r.n1, r.n2) == (len(v), *((v == a).sum() for a in (0, 1, 2))) and abs(r.total - v.sum()) < 1e-9


def test_no_cell_becomes_a_row(spark):
    g = frame(spark, made(20, 9))
    for df in (G.marker_means(g), G.allele_freq(g)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "dosage" not in "".join(x for x in plan.splitlines() if "Generate" in x) and plan.count("Generate ") <= 2
        rows = df.count()
        assert rows == 9


def test_blocks_join_to_the_same_arrays(spark):
    x = made(30, 23)
    odd = spark.createDataFrame([("a", None), ("b", [])], "Hybrid string, dosage array<double>")
    rows = MK.numbered(frame(spark, x).unionByName(odd))
    store = MK.slices(rows, size=4)
    assert store.columns == ["Hybrid", "row", "block", "v"] and store.count() == 30 * 6
    back = rows.join(MK.from_blocks(store), "row", "left").collect()
    for r in back:
        assert r.v == (r.dosage or None)


@pytest.mark.parametrize("size", [4, 4096])
def test_relationship_product_is_the_dense_one(spark, size):
    x = made(60, 23, missing=0)
    z, _, c, _ = codings(x)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 3))
    rows = spark.createDataFrame([(i, z[i].tolist()) for i in range(60)], "row long, dosage array<double>").repartition(4)
    vectors = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "row long, x array<double>")
    got = {r.row: r.y for r in MK.relationship_product(MK.slices(rows, size=size), vectors, 3, c).collect()}
    want = z @ z.T @ v / c
    assert np.allclose([got[i] for i in range(60)], want, atol=1e-9)


def test_moments_equal_dense_ones(spark, monkeypatch):
    monkeypatch.setattr(MK, "BLOCK", 8)
    n, probes = 200, 6
    x = made(n, 37, missing=0)
    z, w, ca, cd = codings(x)
    rng = np.random.default_rng(2)
    y = z @ rng.normal(size=37) + rng.normal(size=n)
    trait = spark.createDataFrame([(f"H{i}", float(v)) for i, v in enumerate(y)] + [("none", 5.0), ("H3x", None)],
                                  "Hybrid string, y double")
    got = {(r.i, r.j): r.value for r in VC.moments(frame(spark, x), trait, probes).collect()}
    k = {"additive": z @ z.T / ca, "dominance": w @ w.T / cd, "residual": np.eye(n)}
    p = np.eye(n) - 1 / n
    s = np.array([[1.0 if hashlib.md5(f"H{i}:{b}".encode()).hexdigest()[0] < "8" else -1.0 for i in range(n)]
                  for b in range(1, probes + 1)]).T
    for (i, j), value in got.items():
        if j is None:
            want = y @ p @ k[i] @ p @ y
        else:
            want = np.mean([(p @ k[i] @ p @ s[:, b]) @ (p @ k[j] @ p @ s[:, b]) for b in range(probes)])
            exact = np.trace(p @ k[i] @ p @ k[j])
            assert abs(want - exact) < 0.4 * exact
        assert abs(value - want) < 1e-7 * max(1, abs(want)), (i, j)


def test_components_are_found_and_not_negative(spark):
    n, m = 400, 60
    rng = np.random.default_rng(8)
    x = made(n, m, seed=9, missing=0)
    z, w, ca, cd = codings(x)
    y = z @ rng.normal(size=m) * np.sqrt(4 / ca) + w @ rng.normal(size=m) * np.sqrt(2 / cd) + rng.normal(size=n)
    trait = spark.createDataFrame([(f"H{i}", float(v)) for i, v in enumerate(y)], "Hybrid string, y double")
    v = {r.component: r.V for r in VC.variance_components(frame(spark, x), trait, 40).collect()}
    # exact traces on the same draw: random ones move the estimates little
    p = np.eye(n) - 1 / n
    k = [p @ a @ p for a in (z @ z.T / ca, w @ w.T / cd, np.eye(n))]
    exact = np.linalg.solve([[np.sum(a * b) for b in k] for a in k], [y @ a @ y for a in k])
    assert np.allclose([v[c] for c in VC.COMPONENTS], exact, atol=0.1 * exact.sum())
    assert abs(exact.sum() - y.var()) < 0.3 * y.var()
    # nothing to explain: no component is negative
    flat = trait.withColumn("y", F.lit(1.0))
    assert {r.V for r in VC.variance_components(frame(spark, x), flat, 2).collect()} == {1.0}
    assert VC.solve([("additive", "additive", 1.0), ("additive", None, -3.0)])["additive"] == 0.0


def test_missing_genotypes_filled_alike_in_both_ways(spark):
    g = frame(spark, made(20, 9))
    df = g.withColumnRenamed("dosage", "geno").unionByName(
        spark.createDataFrame([("n1", None), ("n2", None)], "Hybrid string, geno array<double>"))
    means = G.marker_means(g)
    a, b = (sorted((r.Hybrid, str(r.geno)) for r in MX.fill_missing_genotypes(df, means, k).collect()) for k in (100, 0))
    assert a == b and len(a) == 22 and all(x[1] != "None" for x in a)
