"""Mixing: posteriors and rates against numpy, targets met, copies expected."""

import numpy as np
import pytest

from trialspark.llm import soft_mixing as M
from trialspark.llm.common import table


def numpy_rates(tok, p, shares, anchor, pull=M.PULL):
    """Long plain projected gradient descent on the same objective."""
    total = tok @ p
    want = total.sum() if anchor is None else total[anchor] / shares[anchor]
    target = want * np.array(shares)
    r, step = np.ones(len(tok)), 0.9 / (p * tok[:, None]).T.__matmul__(p).sum()
    for _ in range(60_000):
        off = (tok * r) @ p - target
        r = np.maximum(0, r - step * (p @ off + pull * total.sum() * (r - 1)))
    return r, target


@pytest.mark.parametrize("shares, anchor", [([0.5, 0.3, 0.2], None), ([0.9, 0.06, 0.04], 0), ([0.2, 0.2, 0.6], 2)])
def test_rates_equal_plain_projected_gradient(spark, shares, anchor):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.5, 0.4, 0.3], 60)
    tok = rng.integers(0, 100, 60).astype(float)
    df = spark.createDataFrame([(int(t), *map(float, x)) for t, x in zip(tok, p)], "tokens long, p0 double, p1 double, p2 double")
    lam, got, target = M.fit_rates(df, shares, anchor)
    want, t = numpy_rates(tok, p, shares, anchor)
    mine = np.maximum(0, 1 - p @ np.array(lam))
    assert np.allclose(target, t)
    assert np.abs(mine - want).max() < 2e-2
    assert np.allclose(got, (tok * mine) @ p)


def test_query_meets_the_targets_and_classifies(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = M.document_rates(docs, labels).collect()
    assert len(rows) == docs.count()
    names = sorted(M.TARGETS)
    p = np.array([[r[f"p_{d}"] for d in names] for r in rows])
    tok, rate = np.array([r.tokens for r in rows]), np.array([r.rate for r in rows])
    assert np.allclose(p.sum(1), 1) and (rate >= 0).all()
    got = (tok * rate) @ p
    assert np.allclose(got / got.sum(), [M.TARGETS[d] for d in names], atol=0.01)
    assert abs(got[0] / (tok @ p)[0] - 1) < 0.01  # the anchor's total stays
    copies = np.array([r.copies for r in rows])
    assert (np.abs(copies - rate) < 1).all()
    truth = {r.id: r.domain for r in M.quality_labels(labels).collect()}
    known = [i for i, r in enumerate(rows) if r.doc_id in truth]
    assert np.mean([names[p[i].argmax()] == truth[rows[i].doc_id] for i in known]) > 0.8


def test_mix_repeats_rows_as_planned(spark):
    rows = [(i, f"good words here {i} alpha beta", None) for i in range(60)] + [
        (100 + i, f"zzz junk {i} zzz qqq", None) for i in range(60)] + [
        (300, None, "x"), (301, "", "x"), (None, "zzz qqq", "x"), (5, "good words here 5 alpha beta", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, copies string").selectExpr("*", "1 as tokens", "2 as k1")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)] + [(None, 1, 1), (7, None, None)],
                                   "doc_id long, quality int, toxic int")
    out = M.mix(df, labels, {"good": 0.9, "poor": 0.1}, "good")
    assert out.columns == df.columns
    n = {}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert sum(n.get(i, 0) for i in range(60)) > 3 * sum(n.get(100 + i, 0) for i in range(60))
    # one very long good document outweighs all others in tokens, so poor ones are repeated to make up a tenth
    long = df.union(df.limit(1).selectExpr("302l", "repeat('alpha ', 50000)", "copies", "tokens", "k1"))
    n = [r.doc_id for r in M.mix(long, labels, {"good": 0.9, "poor": 0.1}, "good").collect()]
    assert 302 in n and sum(100 <= (i or 0) < 160 for i in n) > 3 * 60
    assert M.mix(df.limit(0), labels).count() == 0
    assert M.mix(df, labels.limit(0), {"good": 0.5, "poor": 0.5}, None).count() == len(rows)


def test_calibration_is_the_logistic_optimum(spark):
    rng = np.random.default_rng(5)
    n, k = 400, 3
    y = rng.choice(k, n, p=[0.7, 0.2, 0.1])
    m = rng.normal(size=(n, k)) * 0.4
    m[np.arange(n), y] += 0.6
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(names[c], *map(float, x)) for c, x in zip(y, m)], "domain string, m0 double, m1 double, m2 double")
    factor, bias = M.calibrate(df, [-1.0, -1.0, -1.0], names)

    def soft(f, b):
        z = f * m + b
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    f, b = 1.0, np.full(k, -1.0)  # plain gradient descent on the same loss
    for _ in range(20_000):
        r = soft(f, b)
        r[np.arange(n), y] -= 1
        f, b = f - 0.5 * ((r * m).sum() + M.RIDGE * (f - 1)) / n, b - 0.5 * (r.sum(0) + M.RIDGE * (b + 1)) / n
    assert abs(factor - f) < 1e-4 and np.allclose(soft(factor, np.array(bias)), soft(f, b), atol=1e-4)
    assert np.allclose(soft(factor, np.array(bias)).mean(0), np.bincount(y, minlength=k) / n, atol=1e-4)
    assert M.calibrate(df.limit(0), [-1.0, -2.0, -3.0], names) == (1.0, [-1.0, -2.0, -3.0])


def test_posteriors_agree_with_labels_that_taught_nothing(spark):
    """Larger table: of the labelled documents beyond the sample, as many are expected in a domain as are labelled so."""
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    known = M.quality_labels(labels)
    taught = known.filter("id % 2 = 0")
    domains = sorted(M.TARGETS)
    rows = M.mixing_rates(docs, taught, M.TARGETS, M.ANCHOR).join(known.filter("id % 2 = 1"), M.F.col("doc_id") == M.F.col("id")).collect()
    p = np.array([[r[f"p_{d}"] for d in domains] for r in rows])
    share = np.array([np.mean([r.domain == d for r in rows]) for d in domains])
    assert np.abs(p.mean(0) - share).max() < 0.03
    assert np.mean([domains[i] == r.domain for i, r in zip(p.argmax(1), rows)]) > 0.85


def test_kept_columns_may_not_clash(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string").selectExpr("*", "1 as Tokens")
    with pytest.raises(ValueError):
        M.mixing_rates(df, spark.createDataFrame([], "id long, domain string"), M.TARGETS, keep=["Tokens"])
