"""Fixed-effect operators against dense least squares and hand-made edge cases."""

import numpy as np
import pytest

from trialspark.operators import trial_stats as TS

SCHEMA = "id long, Year int, Field_Location string, Hybrid string, Env string, Hybrid_Env string, " \
         "Replicate int, Yield_Mg_ha double"


def random_design(seed, n_cells=12, n_levels=4, n_rows=150, years=(2020, 2021)):
    rng = np.random.default_rng(seed)
    rows = []
    i = 0
    for y in years:
        cell_eff = rng.normal(0, 3, n_cells)
        lev_eff = rng.normal(0, 2, n_levels)
        for _ in range(n_rows):
            c = int(rng.integers(0, n_cells))
            lv = int(rng.integers(1, n_levels + 1))
            val = 10 + cell_eff[c] + lev_eff[lv - 1] + rng.normal(0, 1)
            if rng.random() < 0.03:
                val += 15
            rows.append((i, y, "L1", f"H{c}", f"L1_{y}", f"H{c}|L1_{y}", lv, float(val)))
            i += 1
    return rows


def dense_resid(rows):
    """Residuals of y ~ cell + level per year via numpy lstsq."""
    out = {}
    for y in sorted({r[1] for r in rows}):
        sub = [r for r in rows if r[1] == y]
        cells = sorted({r[5] for r in sub})
        levels = sorted({r[6] for r in sub})
        X = np.zeros((len(sub), len(cells) + len(levels) - 1))
        for k, r in enumerate(sub):
            X[k, cells.index(r[5])] = 1
            li = levels.index(r[6])
            if li > 0:
                X[k, len(cells) + li - 1] = 1
        yv = np.array([r[7] for r in sub])
        beta, *_ = np.linalg.lstsq(X, yv, rcond=None)
        res = yv - X @ beta
        sd = res.std(ddof=1)
        for r, e in zip(sub, res):
            out[r[0]] = (e, int(abs(e) > 2 * sd))
    return out


def dense_blue(rows):
    """Hybrid coefficients of y ~ 0 + hybrid + level (full-rank design) per site."""
    out = {}
    for y in sorted({r[1] for r in rows}):
        sub = [r for r in rows if r[1] == y]
        hyb = sorted({r[3] for r in sub})
        levels = sorted({r[6] for r in sub})
        X = np.zeros((len(sub), len(hyb) + len(levels) - 1))
        for k, r in enumerate(sub):
            X[k, hyb.index(r[3])] = 1
            li = levels.index(r[6])
            if li > 0:
                X[k, len(hyb) + li - 1] = 1
        beta, *_ = np.linalg.lstsq(X, np.array([r[7] for r in sub]), rcond=None)
        for h, b in zip(hyb, beta[:len(hyb)]):
            out[(y, h)] = b
    return out


@pytest.mark.parametrize("seed,levels", [(1, 2), (2, 3), (3, 4)])
def test_outlier_flag_matches_dense_lstsq(spark, seed, levels):
    rows = random_design(seed, n_levels=levels)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: (r["RESID"], r["out_flag"]) for r in TS.outlier_flag(df).collect()}
    want = dense_resid(rows)
    assert set(got) == set(want)
    for k, (e, f) in want.items():
        assert got[k][0] == pytest.approx(e, abs=1e-8)
        assert got[k][1] == f


@pytest.mark.parametrize("seed,levels", [(4, 2), (5, 3), (6, 4)])
def test_blue_matches_dense_lstsq(spark, seed, levels):
    rows = random_design(seed, n_levels=levels, n_rows=200)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["Year"], r["Hybrid"]): r["Yield_Mg_ha"] for r in TS.blue_replicated(df).collect()}
    want = dense_blue(rows)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-8)


def test_disconnected_site_gives_raw_means(spark):
    # hybrids of replicate 1 and replicate 2 are disjoint: the replicate contrast is aliased
    rows = [(0, 2020, "A", "H1", "A_2020", "x", 1, 4.0), (1, 2020, "A", "H1", "A_2020", "x", 1, 6.0),
            (2, 2020, "A", "H2", "A_2020", "x", 1, 1.0), (3, 2020, "A", "H3", "A_2020", "x", 2, 9.0),
            (4, 2020, "A", "H3", "A_2020", "x", 2, 11.0), (5, 2020, "A", "H4", "A_2020", "x", 2, 3.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["Hybrid"]: r["Yield_Mg_ha"] for r in TS.blue_replicated(df).collect()}
    assert got == {"H1": 5.0, "H2": 1.0, "H3": 10.0, "H4": 3.0}


def test_single_replicate_site_passes_rows_through(spark):
    rows = [(0, 2020, "A", "H1", "A_2020", "x", 1, 4.0), (1, 2020, "A", "H1", "A_2020", "x", 1, 6.0),
            (2, 2020, "B", "H1", "B_2020", "y", 1, 2.0), (3, 2020, "B", "H1", "B_2020", "y", 2, 3.0),
            (4, 2020, "A", "H2", "A_2020", "z", 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    single = sorted((r["Field_Location"], r["Yield_Mg_ha"]) for r in TS.blue_single_rep(df).collect())
    assert single == [("A", 4.0), ("A", 6.0)]
    blues = [(r["Field_Location"], r["Env"]) for r in TS.blue_replicated(df).collect()]
    assert blues == [("B", "B_2020")]


def test_singleton_cell_has_zero_residual(spark):
    rows = random_design(7, n_cells=5, n_levels=2, n_rows=60, years=(2020,))
    rows.append((999, 2020, "L1", "HX", "L1_2020", "HX|L1_2020", 1, 500.0))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: r for r in TS.outlier_flag(df).collect()}
    assert got[999]["RESID"] == pytest.approx(0.0, abs=1e-9)
    assert got[999]["out_flag"] == 0


def test_missing_trait_and_replicate_rows_are_excluded(spark):
    rows = random_design(8, n_rows=40, years=(2020,))
    rows.append((1000, 2020, "L1", "H1", "L1_2020", "H1|L1_2020", None, 5.0))
    rows.append((1001, 2020, "L1", "H1", "L1_2020", "H1|L1_2020", 1, None))
    df = spark.createDataFrame(rows, SCHEMA)
    ids = {r["id"] for r in TS.outlier_flag(df).collect()}
    assert 1000 not in ids and 1001 not in ids and len(ids) == 40


def test_hot_cell_with_a_third_of_the_rows(spark):
    """One cell holds a third of all rows; the skew-split sort-merge join still gives exact residuals."""
    rows = random_design(11, n_cells=10, n_levels=2, n_rows=600, years=(2020,))
    rng = np.random.default_rng(3)
    hot = [(10_000 + k, 2020, "L1", "H0", "L1_2020", "H0|L1_2020", int(rng.integers(1, 3)),
            float(12 + rng.normal(0, 1))) for k in range(300)]
    rows = rows + hot
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(rows, SCHEMA)
        got = {r["id"]: (r["RESID"], r["out_flag"]) for r in TS.outlier_flag(df).collect()}
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    want = dense_resid(rows)
    assert set(got) == set(want)
    for k, (e, f) in want.items():
        assert got[k][0] == pytest.approx(e, abs=1e-8)
        assert got[k][1] == f


def test_batch_with_one_replicate_level(spark):
    """No contrast to solve: residuals are deviations from the cell means."""
    rows = [r[:6] + (1,) + r[7:] for r in random_design(12, n_cells=6, n_levels=2, n_rows=80, years=(2021,))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"]: (r["RESID"], r["out_flag"]) for r in TS.outlier_flag(df).collect()}
    want = dense_resid(rows)
    for k, (e, f) in want.items():
        assert got[k][0] == pytest.approx(e, abs=1e-8)
        assert got[k][1] == f
    sd = TS.residual_sd(df).first()
    assert sd["n"] == 80
    assert sd["resid_sd"] == pytest.approx(np.std([e for e, _ in want.values()], ddof=1))


def test_a_large_offset_flags_the_same_rows(spark):
    import random
    rnd = random.Random(3)
    rows = [(f"c{i % 40}", 2020, i % 3 + 1, rnd.gauss(0, 1) + (9 if i % 61 == 0 else 0)) for i in range(600)]
    flags = []
    for offset in (0.0, 1e6, 1e9):
        df = spark.createDataFrame([(i, c, y, r, v + offset) for i, (c, y, r, v) in enumerate(rows)],
                                   "id long, Hybrid_Env string, Year int, Replicate int, Yield_Mg_ha double")
        flags.append(sorted(r["id"] for r in TS.outlier_filter(TS.outlier_flag(df)).collect()))
    assert len(flags[0]) < 600 and flags[0] == flags[1] == flags[2]


def test_sites_without_replicate_numbers_pass_through(spark):
    rows = [("A", None, "H1", 1.0), ("A", None, "H2", 2.0), ("B", 1, "H1", 3.0), ("C", 1, "H1", 4.0), ("C", 2, "H1", 6.0)]
    df = spark.createDataFrame([(2020, s, r, h, y, f"{s}_2020") for s, r, h, y in rows],
                               "Year int, Field_Location string, Replicate int, Hybrid string, Yield_Mg_ha double, Env string")
    _, single = TS.blues_and_single_rep(df)
    want = [("A", 1.0), ("A", 2.0), ("B", 3.0)]
    assert sorted((r["Field_Location"], r["Yield_Mg_ha"]) for r in single.collect()) == want
    assert sorted((r["Field_Location"], r["Yield_Mg_ha"]) for r in TS.blue_single_rep(df).collect()) == want


def test_outlier_flag_writes_the_cells_once(spark):
    from trialspark.session import stage_scope
    rows = [(f"H{h}|E", 2020, r, float(h % 7 + r)) for h in range(60) for r in (1, 2)]
    df = spark.createDataFrame(rows, "Hybrid_Env string, Year int, Replicate int, Yield_Mg_ha double")
    with stage_scope(spark) as paths:
        assert TS.outlier_flag(df).count() == 120
        sizes = [spark.read.parquet(p).count() for p in paths]
    assert sum(n >= 60 for n in sizes) == 1


def test_level_moments_take_one_row_per_cell_and_level(spark):
    cells = spark.createDataFrame([(1, 4, 5.0, [(1, 3, 4.0, 2.0), (2, 1, 8.0, 0.0)]), (1, 2, 7.0, [(1, 2, 7.0, 0.5)])],
                                  "b int, _n long, _mean double, _levels array<struct<_lv:long,_n:long,_m:double,_css:double>>")
    got = {r["_l"]: (r["_t"], r["_nl"], r["_b"], r["_p"]) for r in TS._level_moments(cells, ["b"]).collect()}
    assert got == {1: (2.0 + 3 + 0.5, 5.0, -3.0, 9 / 4 + 2), 2: (9.0, 1.0, 3.0, 1 / 4)}
