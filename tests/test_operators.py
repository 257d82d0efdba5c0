"""Hand-written edge frames for filters, aggregates, imputation, genotype codings, ensembles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.functions import keys as K
from trialspark.operators import aggregate as A
from trialspark.operators import ensemble as EN
from trialspark.operators import filters as FL
from trialspark.operators import genotype as G
from trialspark.operators import projection as P
from trialspark.operators.impute import impute_group_mean
from trialspark.operators.ordering import with_row_index, with_weighted_start


def test_strict_vs_skip_mean(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", None), ("A", 3.0), ("B", None)], "Env string, w double")
    strict = {r["Env"]: r["w"] for r in A.group_mean(df, "Env", ["w"]).collect()}
    skip = {r["Env"]: r["w"] for r in A.group_mean(df, "Env", ["w"], na_rm=True).collect()}
    assert strict == {"A": None, "B": None}
    assert skip == {"A": 2.0, "B": None}


def test_sparse_rows_strictly_below_half(spark):
    df = spark.createDataFrame([(1, None, None, 4.0), (1, 2.0, None, 4.0)], "a int, b double, c double, d double")
    out = FL.drop_sparse_rows(df).collect()
    assert len(out) == 1 and out[0]["b"] == 2.0


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (None,)], "x double")
    got = [r[0] for r in df.select(K.round_half_even("x")).collect()]
    assert got == [0.0, 2.0, 2.0, -0.0, None]


def test_split_key_pads_and_truncates(spark):
    df = spark.createDataFrame([("L1_1_2018",), ("A",)], "Env string")
    got = [tuple(r) for r in df.select(*K.split_key("Env")).collect()]
    assert got == [("L1", "1"), ("A", None)]


def test_recode_keeps_unlisted_values(spark):
    df = spark.createDataFrame([("MOH1_1_2018",), ("MOH1_2_2020",), ("X_2019",), (None,)], "Env string")
    got = [r[0] for r in df.select(K.recode("Env", K.ENV_RECODE)).collect()]
    assert got == ["MOH1_2018", "MOH1_2020", "X_2019", None]


def test_filters_null_semantics(spark):
    df = spark.createDataFrame([(2014, "Replicate1"), (2019, None), (None, "H1")], "Year int, Hybrid string")
    assert FL.filter_not_in(df, "Year", [2014]).count() == 2          # NULL year kept
    assert FL.filter_in(df, "Year", [2014, 2019]).count() == 2
    assert FL.exclude_pattern(df, "Hybrid", "Replicate").count() == 2  # NULL hybrid kept
    assert FL.drop_missing(df, "Year").count() == 2


def test_align_columns_fills_only_absent(spark):
    test = spark.createDataFrame([(1.0, None, 9.0)], "c double, a double, x double")
    out = P.align_columns(test, ["a", "b", "c"])
    assert out.columns == ["a", "b", "c"]
    assert tuple(out.first()) == (None, 0, 1.0)


def test_drop_positions_and_select_positions(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "a int, b int, c int, d int, e int")
    assert P.drop_positions(df, [2, 3]).columns == ["a", "d", "e"]
    assert P.select_positions(df, 2, 4).columns == ["b", "c", "d"]


def test_cast_numeric_text(spark):
    df = spark.createDataFrame([("1.5", "x"), ("NA", "y"), ("abc", "z")], "v string, k string")
    got = [r["v"] for r in P.cast_numeric(df, ["v"]).collect()]
    assert got == [1.5, None, None]


def test_first_per_key_in_order(spark):
    df = spark.createDataFrame([("A", 3, 1.0), ("A", 1, 2.0), ("B", 2, None), ("B", 5, 7.0)],
                               "Env string, ord int, v double")
    got = {r["Env"]: (r["ord"], r["v"]) for r in A.first_per_key(df, "Env", "ord").collect()}
    assert got == {"A": (1, 2.0), "B": (2, None)}


def test_impute_group_mean_row_weighted(spark):
    df = spark.createDataFrame([("L1", 1.0, 10.0), ("L1", 3.0, None), ("L1", None, None), ("L2", None, 5.0)],
                               "Field_Location string, a double, Yield_Mg_ha double")
    got = sorted(tuple(r) for r in impute_group_mean(df).collect())
    # a: L1 mean 2.0 fills the NULL; L2 has no value -> stays NULL; the target is excluded
    assert got == sorted([("L1", 1.0, 10.0), ("L1", 3.0, None), ("L1", 2.0, None), ("L2", None, 5.0)])


def test_column_profile_matches_numpy(spark):
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = A.column_profile(df, ["x"]).first()
    arr = np.array([v for v in vals if v is not None])
    assert r["q1"] == pytest.approx(np.quantile(arr, 0.25))
    assert r["median"] == pytest.approx(np.quantile(arr, 0.5))
    assert r["q3"] == pytest.approx(np.quantile(arr, 0.75))
    assert r["mean"] == pytest.approx(arr.mean())
    assert r["na_count"] == 1


def test_row_index_is_a_permutation(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"))
    idx = with_row_index(df, ["k"], "pos")
    got = sorted((r["k"], r["pos"]) for r in idx.collect())
    assert [p for _, p in got] == list(range(5000))


GENO = [("H1", [0.0, 0.5, None, None]), ("H2", [1.0, 0.5, 1.0, None]), ("H3", [0.0, None, 0.5, None])]


def _geno(spark):
    return spark.createDataFrame(GENO, "Hybrid string, dosage array<double>")


def test_genotype_impute_and_codings(spark):
    g = G.scale_dosage(_geno(spark))
    gi = {r["Hybrid"]: r["dosage"] for r in G.impute_markers(g).collect()}
    # marker means 2/3 -> 1, 1 -> 1, 1.5 -> 2 (half-even), all-missing stays NULL
    assert gi["H1"] == [0.0, 1.0, 2.0, None]
    assert gi["H3"] == [0.0, 1.0, 1.0, None]
    z = {r["Hybrid"]: r["z"] for r in G.additive_coding(G.impute_markers(g)).collect()}
    # additive coding is centred per marker; an all-missing marker is 0
    cols = np.array([z[h] for h in ("H1", "H2", "H3")])
    assert np.allclose(cols.mean(axis=0), 0.0)
    assert all(v[3] == 0.0 for v in z.values())
    f = G.allele_freq(G.impute_markers(g)).orderBy("i").collect()
    for r in f[:3]:
        assert r["p0"] + r["p2"] == pytest.approx(1.0)
    assert f[3]["p0"] is None and f[3]["p2"] is None


def test_dominance_coding_classes(spark):
    g = spark.createDataFrame([("A", [0.0, 1.0, 2.0]), ("B", [2.0, 1.0, None])], "Hybrid string, dosage array<double>")
    w = {r["Hybrid"]: r["w"] for r in G.dominance_coding(g).collect()}
    p = [2 / 4, 2 / 4, 4 / 4]  # allele-2 frequencies (marker 3: NULL not counted)
    assert w["A"][0] == pytest.approx(-2 * p[0] ** 2)
    assert w["A"][1] == pytest.approx(2 * p[1] * (1 - p[1]))
    assert w["A"][2] == pytest.approx(-2 * (1 - p[2]) ** 2)
    assert w["B"][2] == pytest.approx(-2 * p[2] ** 2)  # missing -> 0 first


def test_weighted_ensemble(spark):
    a = spark.createDataFrame([("E", "H", 10.0), ("E", "X", 1.0)], "Env string, Hybrid string, Yield_Mg_ha double")
    d = spark.createDataFrame([("E", "H", 5.0)], "Env string, Hybrid string, Yield_Mg_ha double")
    w = spark.createDataFrame([("additive", 4.0), ("dominance", 1.0), ("residual", 3.0)], "component string, V double")
    got = EN.weighted_ensemble({"additive": a, "dominance": d}, w).collect()
    assert [(r["Hybrid"], r["Yield_Mg_ha"]) for r in got] == [("H", 9.0)]
    eq = EN.equal_ensemble({"additive": a, "dominance": d}).collect()
    assert [(r["Hybrid"], r["Yield_Mg_ha"]) for r in eq] == [("H", 7.5)]


def test_weighted_start_is_a_prefix_sum(spark):
    rows = [(k, (k * 37) % 11 + 1) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, w long")
    got = sorted((r["k"], r["start"]) for r in with_weighted_start(df, ["k"], "w", "start").collect())
    acc, want = 0, []
    for k, w in rows:
        want.append((k, acc))
        acc += w
    assert got == want


def test_long_form_marker_path_equals_broadcast_path(spark):
    odd = spark.createDataFrame([("A", None), ("B", []), ("C", [1.0]), ("C", [0.0, None]), ("C", [0.0, None]), (None, [None])],
                                "Hybrid string, dosage array<double>")
    g = G.scale_dosage(_geno(spark).unionByName(odd))
    for fn, out in ((G.impute_markers, "dosage"), (G.additive_coding, "z"), (G.dominance_coding, "w")):
        src = g if fn is G.impute_markers else G.impute_markers(g)
        a = sorted(str((r["Hybrid"], r[out])) for r in fn(src).collect())
        b = sorted(str((r["Hybrid"], r[out])) for r in fn(src, max_markers=0).collect())
        assert a == b and len(a) == g.count()
        assert "('A', None)" in a and "('B', [])" in a


def test_ensembles_test_presence_per_component(spark):
    s = "Env string, Hybrid string, Yield_Mg_ha double"
    a = spark.createDataFrame([("E", "X", 1.0), ("E", "X", 3.0), ("E", "Y", 4.0), ("E", "Y", 6.0)], s)
    b = spark.createDataFrame([("E", "Y", 9.0)], s)
    assert [tuple(r) for r in EN.equal_ensemble({"a": a, "b": b}).collect()] == [("E", "Y", 7.0)]
    for w in ([("a", 1.0)], [("a", 1.0), ("a", 2.0), ("b", 1.0)]):
        with pytest.raises(ValueError):
            EN.weighted_ensemble({"a": a, "b": b}, spark.createDataFrame(w, "component string, V double"))


def test_weighted_ensemble_with_zero_weights_only(spark):
    s = "Env string, Hybrid string, Yield_Mg_ha double"
    a, b = (spark.createDataFrame([("E", "X", y)], s) for y in (2.0, 6.0))
    w = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("residual", 3.0)], "component string, V double")
    assert EN.weighted_ensemble({"a": a, "b": b}, w).first()["Yield_Mg_ha"] == 4.0


def test_two_sub_sites_keep_their_own_weather(spark):
    from trialspark.plans import matrices as MX
    rows = spark.createDataFrame([("H1", "L1_1_2024", "H1_L1"), ("H1", "L1_2_2024", "H1_L1")],
                                 "Hybrid string, Env string, Hybrid_Field string")
    weather = spark.createDataFrame([("L1_1_2024", 1.0), ("L1_2_2024", 2.0)], "Env string, w double")
    got = sorted((r["Env"], r["w"]) for r in MX.assemble(rows, weather, None).collect())
    assert got == [("L1_1_2024", 1.0), ("L1_2_2024", 2.0)]


def test_external_blue_table_renamed_and_keyed(spark):
    from trialspark.plans.phenotype import PHENO_COLUMNS, phenotype_from_external
    ext = spark.createDataFrame([("H1", "L1", 2019, "L1_2019", 7.5)],
                                "Hybrid string, `Field.Location` string, Year int, Env string, `Yield.Mg.ha` double")
    out = phenotype_from_external(ext)
    assert out.columns == PHENO_COLUMNS
    assert tuple(out.first()) == ("H1", "L1", 2019, "L1_2019", "H1_L1_2019", 7.5)
