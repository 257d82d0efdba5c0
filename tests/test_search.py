"""Search ledger: restarts, proposals, scores."""

import numpy as np
import pytest

from tests.test_boosting import data, frame
from trialspark.operators import binning as BI
from trialspark.plans import model as MD
from trialspark.plans import search as SE

SPACE = {"n_estimators": (2, 4, "log-uniform"), "max_depth": (1, 3, "uniform"), "learning_rate": (0.05, 0.9, "log-uniform"),
         "reg_alpha": (1, 50, "log-uniform")}


@pytest.fixture(scope="module")
def binned(spark):
    x, y, fold = data(150)
    df = frame(spark, x, y, fold)
    bins = BI.find_bins(df, ["a", "b", "c"], "geno")
    return BI.binned_blocks(df, bins, "y", "fold"), bins


def test_a_restart_repeats_nothing_and_ends_alike(spark, binned, tmp_path, monkeypatch):
    blocks, bins = binned
    whole = SE.Ledger(spark, str(tmp_path / "whole"))
    best, mse = SE.search(blocks, bins.n_bins, SPACE, 7, [0, 1, 2], whole, batch=3, seed=2)
    assert len(mse) == 7 and min(mse.values()) == mse[[k for k, c in whole.candidates.items() if c == best][0]]

    fitted, fit_many = [], SE.fit_many

    def dies(b, n, specs, finished):
        def some(done):
            finished(dict(list(done.items())[:4]))  # the driver ends with a part of the scores written
            raise KeyboardInterrupt
        fit_many(b, n, specs, finished=some)

    def counts(b, n, specs, finished):
        fitted.extend(specs)
        return fit_many(b, n, specs, finished=finished)

    path = str(tmp_path / "cut")
    monkeypatch.setattr(SE, "fit_many", dies)
    for _ in range(2):
        with pytest.raises(KeyboardInterrupt):
            SE.search(blocks, bins.n_bins, SPACE, 7, [0, 1, 2], SE.Ledger(spark, path), batch=3, seed=2)
    half = SE.Ledger(spark, path)
    assert 0 < len(half.scores) < 21
    monkeypatch.setattr(SE, "fit_many", counts)
    again = SE.Ledger(spark, path)
    assert SE.search(blocks, bins.n_bins, SPACE, 7, [0, 1, 2], again, batch=3, seed=2) == (best, pytest.approx(mse))
    assert len(fitted) == 21 - len(half.scores) and again.candidates == whole.candidates
    rows = again.table().collect()
    assert len({(r.candidate, r.fold) for r in rows}) == len(rows) == 21
    for r in rows:
        s, n = whole.scores[r.candidate, r.fold]
        assert abs(r.mse - s / n) < 1e-9 and r.n == n


def test_proposals_learn():
    rng = np.random.RandomState(0)
    space = {"learning_rate": (0.001, 1.0, "log-uniform"), "max_depth": (1, 20, "uniform")}
    loss = lambda c: abs(np.log(c["learning_rate"] / 0.03)) + abs(c["max_depth"] - 7) / 5
    scored = [(c, loss(c)) for c in (SE.draw(space, rng) for _ in range(30))]
    new = SE.propose(space, scored, 20, 30, 1)
    assert new == SE.propose(space, scored, 20, 30, 1)
    assert np.mean([loss(c) for c in new]) < 0.6 * np.mean([s for _, s in scored])
    for c in new:
        assert 0.001 <= c["learning_rate"] <= 1.0 and 1 <= c["max_depth"] <= 20 and isinstance(c["max_depth"], int)


def test_candidates_of_the_analysis_spaces_are_parameters():
    for space in (MD.BOOSTED_SPACE, MD.ENV_ONLY_SPACE, MD.LEAF_WISE_SPACE):
        for c in SE.propose(space, [], 10, 0, 3):
            p = SE.TreeParams.of(c)
            assert all(getattr(p, k) == v and space[k][0] <= v <= space[k][1] for k, v in c.items())
            assert np.allclose(SE.to_unit(space, c), SE.to_unit(space, SE.from_unit(space, SE.to_unit(space, c))), atol=0.2)


def test_a_search_needs_something_to_do(spark, binned, tmp_path):
    with pytest.raises(ValueError):
        SE.search(binned[0], binned[1].n_bins, SPACE, 0, [0], SE.Ledger(spark, str(tmp_path / "x")))
