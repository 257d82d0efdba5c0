"""Histogram boosting against a plain numpy version that tries every split on rows."""

import heapq

import numpy as np
import pyarrow as pa
import pytest

from trialspark.operators import binning as BI
from trialspark.operators import boosting as BO
from trialspark.operators.boosting import TreeParams


def shrink(g, a):
    return np.sign(g) * max(abs(g) - a, 0.0)


def score(g, h, p):
    return shrink(g, p.reg_alpha) ** 2 / (h + p.reg_lambda) if h + p.reg_lambda else 0.0


def plain_split(codes, n_bins, g, rows, features, p):
    """Best (gain, feature, cut, null_left, left rows) by trying all."""
    best, own = None, score(g[rows].sum(), len(rows), p)
    for f in features:
        c = codes[f, rows]
        for cut in range(n_bins[f]):
            for null_left in (False, True):
                left = (c <= cut) | (null_left & (c == BI.MISSING)) if null_left else (c <= cut) & (c != BI.MISSING)
                hl, hr = left.sum(), (~left).sum()
                if min(hl, hr) < max(1, p.min_child_weight, p.min_child_samples):
                    continue
                gain = score(g[rows[left]].sum(), hl, p) + score(g[rows[~left]].sum(), hr, p) - own
                if gain > max(p.gamma, 1e-12 * max(own, 1)) and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, f, cut, null_left, left)
    return best


def plain_tree(codes, n_bins, g, rows, features, p):
    """Best-first tree: (splits in order, value per row)."""
    value = np.zeros(codes.shape[1])
    leaves, splits = {1: rows}, []
    heap = []

    def push(i):
        s = plain_split(codes, n_bins, g, leaves[i], features, p) if i.bit_length() - 1 < p.max_depth else None
        if s:
            heapq.heappush(heap, (-s[0], i, s))

    push(1)
    while heap and len(leaves) < (p.num_leaves or 1 << 30):
        _, i, (_, f, cut, null_left, left) = heapq.heappop(heap)
        r = leaves.pop(i)
        leaves[2 * i], leaves[2 * i + 1] = r[left], r[~left]
        splits.append((i, f, cut, null_left))
        push(2 * i)
        push(2 * i + 1)
    return splits, {i: -p.learning_rate * shrink(g[r].sum(), p.reg_alpha) / (len(r) + p.reg_lambda)
                    for i, r in leaves.items() if len(r)}


def plain_place(codes, splits):
    inner = {i: s for i, *s in splits}
    at = np.ones(codes.shape[1], np.int64)
    for j in range(codes.shape[1]):
        while at[j] in inner:
            f, cut, null_left = inner[at[j]]
            c = codes[f, j]
            at[j] = 2 * at[j] + (0 if (null_left if c == BI.MISSING else c <= cut) else 1)
    return at


def plain_fit(codes, n_bins, y, fold, p, held, kept=lambda tree: True):
    train = np.flatnonzero(fold != held) if held is not None else np.arange(len(y))
    base = y[train].mean()
    out, trees = np.full(len(y), base), []
    for t in range(p.n_estimators):
        fit = BO._Fit(0, p, held)
        fit.trees = trees
        fit.start_tree(len(n_bins))
        mask = np.zeros(len(y), bool)
        mask[train] = True
        mask &= kept(t)
        splits, values = plain_tree(codes, n_bins, out - y, np.flatnonzero(mask), fit.features, p)
        at = plain_place(codes, splits)
        out = out + np.array([values.get(i, 0.0) for i in at])
        trees.append((splits, values))
    return out, trees


def data(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 5)), 1)
    x[:, 1] = rng.integers(0, 3, n)
    x[:, 4] = rng.integers(0, 2, n)
    y = x[:, 0] * 2 + (x[:, 1] == 2) * 3 + x[:, 2] * x[:, 4] + rng.normal(size=n) * 0.3
    x[rng.random((n, 5)) < 0.15] = np.nan
    y += np.where(np.isnan(x[:, 3]), 1.5, 0.0)  # NULLs carry signal
    return x, y, rng.integers(0, 3, n)


def frame(spark, x, y, fold, parts=3):
    rows = [(*[None if np.isnan(v) else float(v) for v in r[:3]], [None if np.isnan(v) else float(v) for v in r[3:]],
             float(t), int(k), i) for i, (r, t, k) in enumerate(zip(x, y, fold))]
    return spark.createDataFrame(rows, "a double, b double, c double, geno array<double>, y double, fold int, i int"
                                 ).repartition(parts, "i").sortWithinPartitions("i")


def fitted(spark, x, y, fold, specs, **kw):
    df = frame(spark, x, y, fold)
    bins = BI.find_bins(df, ["a", "b", "c"], "geno")
    blocks = BI.binned_blocks(df, bins, "y", "fold")
    models, scores = BO.fit_many(blocks, bins.n_bins, specs, **kw)
    return df, bins, models, scores


PARAMS = [TreeParams(n_estimators=5, max_depth=3),
          TreeParams(n_estimators=3, max_depth=5, learning_rate=0.5, reg_alpha=4.0, reg_lambda=7.0),
          TreeParams(n_estimators=3, max_depth=6, num_leaves=6, min_child_samples=9),
          TreeParams(n_estimators=2, max_depth=4, gamma=25.0, min_child_weight=20.0),
          TreeParams(n_estimators=4, max_depth=3, colsample_bytree=0.5, seed=5)]


def same(model, trees, codes):
    assert len(model.trees) == len(trees)
    for t, (splits, values) in zip(model.trees, trees):
        inner, todo, got = [], [(0, 1)], {}
        for k, i in todo:
            if t.left[k] >= 0:
                inner.append((i, t.feature[k], t.cut[k], t.null_left[k]))
                todo += [(t.left[k], 2 * i), (t.right[k], 2 * i + 1)]
            else:
                got[i] = t.value[k]
        assert sorted(inner) == sorted(splits)
        for i, v in values.items():
            assert abs(got[i] - v) < 1e-9


def test_equals_the_plain_version(spark):
    x, y, fold = data()
    specs = [(p, h) for p in PARAMS for h in (None, 1)]
    seen = {}
    df, bins, models, scores = fitted(spark, x, y, fold, specs, flush=2, finished=seen.update)
    codes = BI.code_rows(x.T, bins.cuts)
    for k, (p, held) in enumerate(specs):
        want, trees = plain_fit(codes, bins.n_bins, y, fold, p, held)
        same(models[k], trees, codes)
        got = [r.prediction for r in BO.predict(df, models[k], bins).orderBy("i").collect()]
        assert np.allclose(got, want, atol=1e-9)
        if held is None:
            assert scores[k] is None
        else:
            out = fold == held
            assert scores[k][1] == out.sum() and abs(scores[k][0] - ((want - y)[out] ** 2).sum()) < 1e-7
            assert seen[k] == scores[k]


def test_every_parameter_changes_the_fit(spark):
    x, y, fold = data()
    base = TreeParams(n_estimators=3, max_depth=4, seed=1)
    others = [dict(n_estimators=4), dict(learning_rate=0.1), dict(max_depth=2), dict(num_leaves=4), dict(seed=1, subsample=0.5),
              dict(min_child_weight=40.0), dict(min_child_samples=60), dict(colsample_bytree=0.4), dict(gamma=80.0),
              dict(reg_alpha=30.0), dict(reg_lambda=30.0)]
    specs = [(base, None)] + [(TreeParams(**{**base.__dict__, **o}), None) for o in others]
    df, bins, models, _ = fitted(spark, x, y, fold, specs)
    codes = BI.code_rows(x.T, bins.cuts)
    first = models[0].predict_codes(codes)
    for o, m in zip(others, models[1:]):
        assert not np.allclose(first, m.predict_codes(codes)), o


def test_subsample_is_a_share_that_a_retry_repeats():
    kept = [BO._kept(7, 3, 5, 20_000, 0.3) for _ in range(2)]
    assert (kept[0] == kept[1]).all() and abs(kept[0].mean() - 0.3) < 0.02
    assert (kept[0] != BO._kept(7, 4, 5, 20_000, 0.3)).any()


def test_partitions_chunks_and_histogram_bound_leave_the_trees_alone(spark, monkeypatch):
    x, y, fold = data()
    specs = [(PARAMS[0], None), (PARAMS[2], 0)]
    df, bins, models, _ = fitted(spark, x, y, fold, specs)
    monkeypatch.setattr(BO, "CHUNK_BINS", 8)
    monkeypatch.setattr(BO, "HIST_BYTES", 1)  # one node a pass
    monkeypatch.setattr(BI, "BLOCK_BYTES", 100)
    blocks = BI.binned_blocks(df.repartition(7, "i"), bins, "y", "fold")
    again, _ = BO.fit_many(blocks, bins.n_bins, specs)
    for a, b in zip(models, again):
        for s, t in zip(a.trees, b.trees):
            assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and np.allclose(s.value, t.value, atol=1e-12)


def test_edges_exact_and_thinned():
    v, n = np.array([0.0, 1.0, 2.0]), np.array([5, 1, 9])
    assert BI.cuts_of(v, n).tolist() == [0.5, 1.5]
    many = np.arange(10_000.0)
    parts = [(many[i::4], np.ones(2500, np.int64)) for i in range(4)]
    values, counts = BI.merge_summaries(parts, 1000)
    assert counts.sum() == 10_000 and len(values) <= 1000
    cuts = BI.cuts_of(values, counts, 10)
    assert len(cuts) == 9 and np.abs(cuts - np.arange(1000, 10_000, 1000)).max() < 50


def test_nulls_learn_a_direction_and_no_rows_is_a_model_of_no_trees(spark):
    x = np.array([[np.nan], [np.nan], [0.0], [1.0]] * 20)
    y = np.array([5.0, 5.0, 0.0, 5.0] * 20)
    df = spark.createDataFrame([(None if np.isnan(a) else float(a), float(b)) for (a,), b in zip(x, y)], "a double, y double")
    bins = BI.find_bins(df, ["a"])
    model = BO.fit_many(BI.binned_blocks(df, bins, "y"), bins.n_bins,
                        [(TreeParams(n_estimators=1, max_depth=1, learning_rate=1.0, reg_lambda=0.0), None)])[0][0]
    got = {r.a: r.prediction for r in BO.predict(df, model, bins).collect()}
    assert got == {None: 5.0, 0.0: 0.0, 1.0: 5.0}  # NULL with the high values
    none = df.limit(0)
    bins = BI.find_bins(none, ["a"])
    model = BO.fit_many(BI.binned_blocks(none, bins, "y"), bins.n_bins, [(TreeParams(), None)])[0][0]
    assert model.trees == [] and [r.prediction for r in BO.predict(df.limit(1), model, bins).collect()] == [0.0]


def test_model_table_round_trip(spark, tmp_path):
    x, y, fold = data(120)
    df, bins, models, _ = fitted(spark, x, y, fold, [(PARAMS[0], None)])
    BO.write_model(spark, models[0], str(tmp_path / "m"))
    codes = BI.code_rows(x.T, bins.cuts)
    assert (BO.read_model(spark, str(tmp_path / "m")).predict_codes(codes) == models[0].predict_codes(codes)).all()


def test_unknown_parameters_are_an_error():
    with pytest.raises(ValueError):
        TreeParams.of({"n_estimators": 3, "colour": 1})
    with pytest.raises(ValueError):
        TreeParams(max_depth=61)


def _random_tree(rng, n_bins, inner):
    """A full tree with ``inner`` splits over random features, cuts and NULL directions."""
    n = 2 * inner + 1
    f = np.where(np.arange(n) < inner, rng.randint(0, len(n_bins), n), 0)
    left = np.where(np.arange(n) < inner, 2 * np.arange(n) + 1, -1).astype(np.int32)
    return BO.Tree(f, np.where(left >= 0, rng.randint(0, n_bins[f]), 0), rng.rand(n) < 0.5, left,
                   np.where(left >= 0, left + 1, -1).astype(np.int32), rng.randn(n))


def _random_codes(rng, n_bins, n):
    codes = np.stack([rng.randint(0, b, n) for b in n_bins]).astype(np.uint8)
    codes[rng.rand(*codes.shape) < 0.1] = BO.MISSING
    return codes


def test_rows_are_placed_by_bytes_as_row_by_row():
    rng = np.random.RandomState(1)
    n_bins = np.array([254, 2, 4, 1, 60])
    codes = _random_codes(rng, n_bins, 500)
    for inner in (0, 1, 7, 64, 70):
        t = _random_tree(rng, n_bins, inner)
        want = []
        for r in range(codes.shape[1]):
            i = 0
            while t.left[i] >= 0:
                c = codes[t.feature[i], r]
                goes = t.null_left[i] if c == BO.MISSING else c <= t.cut[i]
                i = t.left[i] if goes else t.right[i]
            want.append(i)
        assert t.place(codes).tolist() == want
        if inner <= BO.SMALL_TREE:
            assert t._place_by_node(codes).dtype == np.uint8


@pytest.mark.parametrize("room", [1 << 30, 0])
def test_joint_histograms_give_each_feature_its_own(room):
    rng = np.random.RandomState(2)
    n_bins = np.array([4, 3, 254, 1, 4, 4, 4, 60, 4, 254])
    features = np.array([0, 1, 2, 4, 5, 6, 7, 8, 9])
    n_nodes = 3
    bundles = BO._bundles(features, n_bins, n_nodes, room)
    assert [f for b, e in bundles for f in range(b, e)] == list(range(len(features)))
    assert len(bundles) < len(features) if room else len(bundles) == len(features)
    held, first = None, BO._layout(features, n_bins)[0]
    g, h = np.zeros((n_nodes, first[-1])), np.zeros((n_nodes, first[-1]))
    for _ in range(2):
        codes, grad, slot = _random_codes(rng, n_bins, 300), rng.randn(300), rng.randint(-1, n_nodes, 300)
        held = BO._joint_sums(held, codes, grad, slot, n_nodes, features, n_bins, bundles)
        for k, f in enumerate(features):
            for r in np.flatnonzero(slot >= 0):
                at = first[k] + (n_bins[f] if codes[f, r] == BO.MISSING else codes[f, r])
                g[slot[r], at] += grad[r]
                h[slot[r], at] += 1
    got = BO._single_sums(held, n_nodes, features, n_bins, bundles)
    assert np.allclose(got[0], g) and (got[1] == h).all()


def test_a_task_gets_few_blocks_at_a_time(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(key), []
    bases = BO._bases
    monkeypatch.setattr(BO, "_bases", lambda *a: seen.append(int(spark.conf.get(key))) or bases(*a))
    n_bins = np.full(1000, 4)  # blocks of 4 MB
    empty = spark.createDataFrame([], "block bigint, n bigint, label binary, fold binary, bins binary")
    BO.fit_many(empty, n_bins, [(TreeParams(n_estimators=1), None)])
    assert 1 <= seen[0] <= 4
    assert spark.conf.get(key) == before


def test_small_blocks_are_counted_side_by_side():
    rng, n_bins = np.random.RandomState(3), np.array([4, 3, 5])
    sizes = [50, 20, 70]
    codes = [_random_codes(rng, n_bins, n) for n in sizes]
    margins = [rng.randn(2, n) for n in sizes]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7, 8, 9]), pa.array(sizes), pa.array([np.arange(n, dtype="<f8").tobytes() for n in sizes]),
         pa.array([np.full(n, n, "<i2").tobytes() for n in sizes]), pa.array([c.tobytes() for c in codes]),
         pa.array([m.tobytes() for m in margins])], ["block", "n", "label", "fold", "bins", "margins"])
    (blocks, label, fold, got, m), = BO._parts(iter([batch]), 2)
    assert list(blocks) == [(7, 50), (8, 20), (9, 70)]
    assert len(label) == 140 and fold.tolist() == [n for n in sizes for _ in range(n)]
    assert (got == np.concatenate(codes, axis=1)).all() and (m == np.concatenate(margins, axis=1)).all()
