"""Registered queries: each maps (spark, sf_dir) -> DataFrame over the benchmark tables.

Every query reads whole benchmark tables through the trial views of
``trialspark.sources.fixtures``; array results are returned in long form
(one row per cell) so they compare cell by cell with the DuckDB oracle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.functions import keys as K
from trialspark.functions.keys import build_key, recode, split_key, strip_pattern
from trialspark.operators import aggregate as A
from trialspark.operators import binning as BI
from trialspark.operators import boosting as BO
from trialspark.operators import ensemble as EN
from trialspark.operators import filters as FL
from trialspark.operators import genotype as G
from trialspark.operators import markers as MK
from trialspark.operators import projection as P
from trialspark.operators import trial_stats as TS
from trialspark.operators import variance as VC
from trialspark.operators import impute as IM
from trialspark.operators.joins import join_written
from trialspark.plans import features as FE
from trialspark.plans import folds as FO
from trialspark.plans import matrices as MX
from trialspark.plans import model as MD
from trialspark.plans import phenotype as PH
from trialspark.plans import search as SE
from trialspark.session import materialize, scratch_path
from trialspark.sources import fixtures as V
from trialspark.sources import text as TX

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


MEASURES = ["w1", "w2"]
TEST_YEAR = V.TEST_SHIP_YEAR + V.YEAR_SHIFT
# row order of the phenotype file: by year, then site; the label takes no part
FOLD_ORDER = ["Year", "Field_Location", "Hybrid"]
# fixture parameters: soil drops split columns + first measure; F2 drops one training year
SOIL_DROP_POSITIONS = [2, 3, 4]
SOIL_EXCLUDE_YEARS = [2019]
TEST_SOIL_DROP_POSITIONS = [2, 3]


# ---------------------------------------------------------------- shared building blocks

def _plots(spark, sf):
    return FL.drop_missing(V.trial(spark, sf), "Yield_Mg_ha")


def _weather(spark, sf):
    return V.weather_raw(spark, sf).withColumn("Env", recode("Env", V.FIXTURE_RECODE))


def _locations(spark, sf):
    return PH.test_locations(V.test_template(spark, sf))


def _pheno(spark, sf):
    return PH.phenotype_table(V.trial(spark, sf), _locations(spark, sf))


def _test(spark, sf):
    return PH.test_keys(V.test_template(spark, sf))


def _geno_imputed(spark, sf):
    """Written once: the codings and their frequencies read it instead of imputing again."""
    return materialize(G.impute_markers(G.scale_dosage(V.geno(spark, sf))), "geno_imputed")


def _long(g, col="dosage", value="v"):
    return G.explode_markers(g, col, "Hybrid", value)


# ---------------------------------------------------------------- sources / sinks

@query
def scan_trial(spark, sf):
    """Plots written as tab text with NA markers and read back with a declared schema."""
    t = V.trial(spark, sf)
    path = scratch_path(spark, "trial_tsv")
    TX.write_delimited(t, path)
    return TX.read_delimited(spark, path, t.schema)


@query
def geno_scan(spark, sf):
    """Genotype matrix written as wide marker text and read back as arrays (long output)."""
    g = V.geno(spark, sf)
    m = g.agg(F.max(F.size("dosage")).alias("n")).select(
        F.posexplode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i", "_")).select(
        "i", F.concat(F.lit("m"), F.col("i").cast("string")).alias("marker"))
    path = scratch_path(spark, "geno_txt")
    TX.write_genotype_text(g, m, path)
    back, _ = TX.read_genotype_text(spark, path)
    return _long(back)


@query
def vcf_scan(spark, sf):
    """A VCF written as text (meta lines, ``#CHROM`` line, one line per vector) and read as a plain table."""
    e = V.table(spark, sf, "embeddings")
    body = e.select(F.concat_ws("\t", e["label"].cast("string"), e["vec_id"].cast("string"),
                                F.concat(F.lit("v"), e["vec_id"].cast("string"))).alias("value"))
    head = spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID",)], "value string")
    path = scratch_path(spark, "vcf")
    head.union(body).write.text(path)
    return TX.read_vcf_table(spark, path)


@query
def prediction_csv(spark, sf):
    """Predictions written as CSV with a header and read back."""
    p = V.component_predictions(spark, sf).select("Env", "Hybrid", F.col("y_add").alias("Yield_Mg_ha"))
    path = scratch_path(spark, "predictions")
    TX.write_csv(p, path)
    return TX.read_delimited(spark, path, p.schema, sep=",")


# ---------------------------------------------------------------- projections / scalar functions

@query
def project_trial(spark, sf):
    return P.select_columns(V.trial(spark, sf), ["Hybrid", "Env", "Year", "Yield_Mg_ha"])


@query
def drop_positions(spark, sf):
    """Metadata with location/year split in, then columns 2..4 dropped by position."""
    return FE.soil_block(V.meta(spark, sf), SOIL_DROP_POSITIONS)


@query
def cast_numeric(spark, sf):
    """A measure written as text (with NA) and cast back to double."""
    w = V.weather_raw(spark, sf)
    txt = w.select("ord", "Env", F.coalesce(F.col("w1").cast("string"), F.lit("NA")).alias("w1"))
    return P.cast_numeric(txt, ["w1"])


@query
def select_measures(spark, sf):
    """Weather measures by position (columns 3..4 of the weather table) with the Env key."""
    w = V.weather_raw(spark, sf)
    return w.select("Env", *P.select_positions(w, 3, 4).columns)


@query
def recode_env(spark, sf):
    return _weather(spark, sf)


@query
def align_columns(spark, sf):
    """Weather rows aligned to (Env, w1, w2, ord, w3): w1 kept, w3 absent -> 0, extra dropped."""
    w = V.weather_raw(spark, sf).withColumn("extra", F.lit(1))
    return P.align_columns(w, ["Env", "w1", "w2", "ord", "w3"], fill=0)


@query
def build_keys(spark, sf):
    t = V.trial(spark, sf)
    return t.select("Hybrid", "Env", "Field_Location",
                    build_key("Hybrid", "Env", sep="|").alias("hybrid_env_bar"),
                    build_key("Hybrid", "Env").alias("hybrid_env"),
                    build_key("Hybrid", "Field_Location").alias("hybrid_field"))


@query
def split_env(spark, sf):
    w = V.weather_raw(spark, sf)
    return w.select("ord", "Env", *split_key("Env"))


@query
def strip_prefix(spark, sf):
    t = V.trial(spark, sf)
    coef = F.concat(F.lit("Hybrid"), F.col("Hybrid"))
    return t.select("Hybrid", coef.alias("coef_name"), strip_pattern(coef, "Hybrid").alias("stripped"))


@query
def round_half_even(spark, sf):
    t = V.trial(spark, sf)
    half = F.col("Yield_Mg_ha") / 2
    return t.select("Yield_Mg_ha", half.alias("half"), K.round_half_even(half).alias("rounded"))


# ---------------------------------------------------------------- filters

@query
def filter_years(spark, sf):
    return FL.filter_in(V.trial(spark, sf), "Year", PH.TRAIN_YEARS)


@query
def filter_not_years(spark, sf):
    return FL.filter_not_in(V.trial(spark, sf), "Year", [2017, 2018])


@query
def drop_sparse_rows(spark, sf):
    joined = V.trial(spark, sf).join(V.meta(spark, sf), "Env", "left")
    return FL.drop_sparse_rows(joined)


@query
def drop_missing_trait(spark, sf):
    return FL.drop_missing(V.trial(spark, sf), "Yield_Mg_ha")


@query
def exclude_pattern(spark, sf):
    return FL.exclude_pattern(V.trial(spark, sf), "Hybrid", "H1")


@query
def semi_locations(spark, sf):
    return FL.semi_join_keys(V.trial(spark, sf), _locations(spark, sf), "Field_Location")


@query
def semi_test_sites(spark, sf):
    """Plots whose hybrid is also grown at their location in the test year, one hybrid per part: most have none."""
    plots = V.trial_wide(spark, sf)
    return FL.semi_join_keys(plots, plots.filter(F.col("Year") == TEST_YEAR), ["Field_Location", "Hybrid"])


@query
def semi_weather(spark, sf):
    return FL.semi_join_keys(V.weather_raw(spark, sf), V.meta(spark, sf), "Env")


# ---------------------------------------------------------------- joins

@query
def join_weather(spark, sf):
    return FE.features_weather(_plots(spark, sf), V.weather_raw(spark, sf), MEASURES,
                               V.FIXTURE_RECODE)


@query
def join_meta(spark, sf):
    return join_written(_plots(spark, sf), V.meta(spark, sf), "Env", "left", "meta")


@query
def join_feature_blocks(spark, sf):
    """Metadata rows with the weather means (one row per Env) attached."""
    meta_b = FE.features_meta(_pheno(spark, sf), V.meta(spark, sf), _locations(spark, sf))
    return MX.assemble(meta_b, _weather_means(spark, sf, False), None)


@query
def join_geno(spark, sf):
    """Phenotype rows left-joined with imputed genotype arrays (per-row marker sum / count)."""
    g = _geno_imputed(spark, sf)
    j = _pheno(spark, sf).join(g, "Hybrid", "left")
    return j.select("Hybrid_Env", "Hybrid", "Env", "Yield_Mg_ha",
                    F.aggregate("dosage", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
                     .alias("geno_sum"),
                    F.size(F.filter("dosage", lambda x: x.isNotNull())).alias("geno_n"))


# ---------------------------------------------------------------- aggregates

@query
def weather_mean_strict(spark, sf):
    return FE.weather_means(V.weather_raw(spark, sf), MEASURES, V.FIXTURE_RECODE, na_rm=False)


@query
def weather_mean_skipna(spark, sf):
    return FE.weather_means(V.weather_raw(spark, sf), MEASURES, V.FIXTURE_RECODE, na_rm=True)


@query
def replicate_counts(spark, sf):
    return TS.site_levels(V.trial(spark, sf), ["Year", "Field_Location"], "Replicate", "Yield_Mg_ha")


@query
def first_per_env(spark, sf):
    return A.first_per_key(V.weather_raw(spark, sf), "Env", "ord")


@query
def distinct_locations(spark, sf):
    return A.distinct_values(V.trial(spark, sf), "Field_Location")


@query
def column_profile(spark, sf):
    return A.column_profile(V.trial(spark, sf), ["Year", "Replicate", "Block", "Yield_Mg_ha"])


@query
def null_counts(spark, sf):
    return A.null_counts(join_meta(spark, sf))


@query
def geno_null_cells(spark, sf):
    return A.array_null_cells(_geno_imputed(spark, sf), "dosage")


@query
def table_shape(spark, sf):
    parts = [A.table_shape(V.trial(spark, sf), "trial"),
             A.table_shape(V.weather_raw(spark, sf), "weather"),
             A.table_shape(V.meta(spark, sf), "meta"),
             A.table_shape(V.geno(spark, sf), "geno")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def impute_group_mean(spark, sf):
    return IM.impute_group_mean(join_meta(spark, sf), "Field_Location")


@query
def union_batches(spark, sf):
    replicated, single = TS.blues_and_single_rep(_plots(spark, sf))
    return replicated.unionByName(single)


# ---------------------------------------------------------------- trial statistics

@query
def phenotype_weather(spark: SparkSession, sf: str) -> DataFrame:
    """Minimum slice: BLUEs of replicated sites left-joined with strict weather means."""
    blues = TS.blue_replicated(_plots(spark, sf))
    wm = A.group_mean(_weather(spark, sf), "Env", MEASURES, na_rm=False)
    return blues.join(wm, "Env", "left")


@query
def blue_replicated(spark, sf):
    return TS.blue_replicated(_plots(spark, sf))


@query
def blue_replicated_k2(spark, sf):
    """BLUEs with three replicate levels (two contrasts, solved per site in pandas)."""
    return TS.blue_replicated(FL.drop_missing(V.trial_multi_rep(spark, sf), "Yield_Mg_ha"))


@query
def blue_single_rep(spark, sf):
    return TS.blue_single_rep(_plots(spark, sf))


@query
def outlier_flag(spark, sf):
    return TS.outlier_flag(PH.plot_rows(V.trial(spark, sf))).select(
        "Hybrid_Env", "Hybrid", "Env", "Year", "Field_Location", "Replicate", "Block",
        "Yield_Mg_ha", "RESID", "out_flag")


@query
def residual_sd(spark, sf):
    return TS.residual_sd(PH.plot_rows(V.trial(spark, sf)))


@query
def outlier_filter(spark, sf):
    return TS.outlier_filter(outlier_flag(spark, sf))


@query
def phenotype_table(spark, sf):
    return _pheno(spark, sf)


# ---------------------------------------------------------------- feature blocks

@query
def features_weather(spark, sf):
    return FE.features_weather(_pheno(spark, sf), V.weather_raw(spark, sf), MEASURES,
                               V.FIXTURE_RECODE)


@query
def features_ec(spark, sf):
    return FE.features_ec(_pheno(spark, sf), V.weather_raw(spark, sf), "ord", V.FIXTURE_RECODE)


@query
def features_meta(spark, sf):
    return FE.features_meta(_pheno(spark, sf), V.meta(spark, sf), _locations(spark, sf))


@query
def features_soil(spark, sf):
    return FE.features_soil(_pheno(spark, sf), V.meta(spark, sf), SOIL_DROP_POSITIONS,
                            exclude_years=SOIL_EXCLUDE_YEARS)


@query
def test_features_weather(spark, sf):
    return FE.test_features_weather(_test(spark, sf), V.weather_raw(spark, sf), MEASURES,
                                    V.FIXTURE_RECODE)


@query
def test_features_ec(spark, sf):
    return FE.test_features_ec(_test(spark, sf), V.weather_raw(spark, sf), "ord")


@query
def test_features_meta(spark, sf):
    return FE.test_features_meta(_test(spark, sf), V.meta(spark, sf), _locations(spark, sf))


@query
def test_features_soil(spark, sf):
    return FE.test_features_soil(_test(spark, sf), V.weather_raw(spark, sf),
                                 TEST_SOIL_DROP_POSITIONS, "ord")


# ---------------------------------------------------------------- genotype codings

@query
def geno_dosage(spark, sf):
    return _long(G.scale_dosage(V.geno(spark, sf)))


@query
def marker_means(spark, sf):
    return G.marker_means(G.scale_dosage(V.geno(spark, sf)))


@query
def geno_impute(spark, sf):
    return _long(_geno_imputed(spark, sf))


@query
def allele_freq(spark, sf):
    return G.allele_freq(_geno_imputed(spark, sf))


@query
def marker_variance(spark, sf):
    return G.marker_variance(_geno_imputed(spark, sf))


@query
def marker_two_pq_total(spark, sf):
    return G.total_two_pq(_geno_imputed(spark, sf))


@query
def geno_additive(spark, sf):
    return _long(G.additive_coding(_geno_imputed(spark, sf)), "z", "z")


@query
def geno_dominance(spark, sf):
    return _long(G.dominance_coding(_geno_imputed(spark, sf)), "w", "w")


def _hybrid_means(spark, sf):
    """Mean yield of each hybrid, one hybrid per part."""
    return V.trial_wide(spark, sf).groupBy("Hybrid").agg(F.avg("Yield_Mg_ha").alias("y"))


@query
def relationship_product(spark, sf):
    """Additive relationships times the hybrids' numbers of heterozygous markers, in two passes over the blocks."""
    g = _geno_imputed(spark, sf)
    stats = materialize(MK.block_stats(g), "marker_block_stats")
    rows = MK.numbered(g)
    het = F.size(F.filter("dosage", lambda x: x == 1)).cast("double")
    z = MK.coded(MK.slices(rows), MK.stat_vector(stats, "p2", MK.allele2), "p2",
                 lambda x, p: F.coalesce(x - p * 2, F.lit(0.0)))
    total = G.total_two_pq(g).first()["two_pq_sum"]
    y = MK.relationship_product(materialize(z, "additive_blocks"), rows.select("row", F.array(het).alias("x")), 1, total)
    return rows.join(y, "row").select("Hybrid", F.get("y", F.lit(0)).alias("y"))


@query
def variance_moments(spark, sf):
    """The moment equations of the additive, dominance and residual variances of the hybrid means, four sign vectors."""
    return VC.moments(_geno_imputed(spark, sf), _hybrid_means(spark, sf), 4)


@query
def variance_components(spark, sf):
    """Additive, dominance and residual variances of the hybrid means (component, V)."""
    return VC.variance_components(_geno_imputed(spark, sf), _hybrid_means(spark, sf))


# ---------------------------------------------------------------- model matrices and folds

def train_wide(spark, sf, geno: str | None = "raw"):
    pheno = _pheno(spark, sf)
    meta_b = FE.features_meta(pheno, V.meta(spark, sf), _locations(spark, sf))
    return MX.assemble(meta_b, _weather_means(spark, sf, False), _geno_variant(spark, sf, geno),
                       years=PH.TRAIN_YEARS if geno else None)


def test_wide(spark, sf, geno: str | None = "raw"):
    test = _test(spark, sf)
    meta_t = FE.test_features_meta(test, V.meta(spark, sf), _locations(spark, sf))
    return MX.assemble(meta_t, _weather_means(spark, sf, True), _geno_variant(spark, sf, geno))


def _weather_means(spark, sf, na_rm: bool):
    return FE.weather_means(V.weather_raw(spark, sf), MEASURES, V.FIXTURE_RECODE, na_rm)


def _geno_variant(spark, sf, geno):
    if geno is None:
        return None
    gi = _geno_imputed(spark, sf)
    if geno == "raw":
        return gi
    if geno == "additive":
        return G.additive_coding(gi, out="dosage")
    if geno == "dominance":
        return G.dominance_coding(gi, out="dosage")
    raise ValueError(geno)


def _train_long(df):
    feats = MX.feature_columns(df, MX.TRAIN_KEYS)
    return MX.to_long(df, ["Hybrid_Env", "Hybrid", "Env", "Year", "Yield_Mg_ha"], feats)


@query
def train_matrix(spark, sf):
    return _train_long(train_wide(spark, sf, "raw"))


@query
def train_matrix_additive(spark, sf):
    return _train_long(train_wide(spark, sf, "additive"))


@query
def train_matrix_dominance(spark, sf):
    return _train_long(train_wide(spark, sf, "dominance"))


@query
def train_matrix_env(spark, sf):
    return _train_long(train_wide(spark, sf, None))


@query
def test_matrix(spark, sf):
    # the train columns are the blocks' own; the training rows are not needed for their names
    feats = [c for c in V.meta(spark, sf).columns if c != "Env"] + MEASURES
    test = MX.align_test(test_wide(spark, sf, "raw"), [*MX.TRAIN_KEYS, *feats, "geno"], MX.TEST_KEYS, MX.TRAIN_KEYS)
    return MX.to_long(test, ["Hybrid_Field", "Hybrid", "Env"], feats)


@query
def folds_leave_year_out(spark, sf):
    return FO.leave_one_group_out(train_wide(spark, sf, None), "Year").select(
        "Hybrid_Env", "Year", "fold")


@query
def folds_contiguous(spark, sf):
    t = train_wide(spark, sf, None).select("Year", "Field_Location", "Hybrid", "Hybrid_Env")
    return FO.contiguous_folds(t, FOLD_ORDER, k=5)


@query
def cv_mse(spark, sf):
    """Leave-one-year-out MSE of the training-mean predictor, per fold."""
    t = FO.leave_one_group_out(train_wide(spark, sf, None), "Year")
    return FO.mean_model_cv(t, "Yield_Mg_ha")


# ---------------------------------------------------------------- keys that grow with the data

@query
def outlier_flag_two_year(spark, sf):
    """Outlier flags of two years fitted together, with one residual SD per pair of years."""
    t = PH.plot_rows(V.trial(spark, sf)).withColumn("Pair", F.col("Year") - F.col("Year") % 2).drop("Year")
    return TS.outlier_flag(t, batch=("Pair",))


@query
def outlier_flag_wide(spark, sf):
    """Outlier flags with one hybrid per part: about as many cells as plots."""
    return TS.outlier_flag(PH.plot_rows(V.trial_wide(spark, sf)))


@query
def blue_replicated_wide(spark, sf):
    """BLUEs with one hybrid per part."""
    return TS.blue_replicated(V.trial_wide(spark, sf))


@query
def join_geno_wide(spark, sf):
    """Plots left-joined with the genotypes where some hybrids have none (marker sum and count, else NULL)."""
    j = V.trial_wide(spark, sf).join(_geno_imputed(spark, sf), "Hybrid", "left")
    return j.select("Hybrid", "Env", "Replicate", "Block", "Yield_Mg_ha",
                    F.aggregate("dosage", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("geno_sum"),
                    F.when(F.col("dosage").isNotNull(), F.size(F.filter("dosage", lambda x: x.isNotNull()))).alias("geno_n"))


# ---------------------------------------------------------------- ensembles

def _components(spark, sf):
    p = V.component_predictions(spark, sf)
    return {name: p.select("Env", "Hybrid", F.col(col).alias("Yield_Mg_ha"))
            for name, col in (("additive", "y_add"), ("dominance", "y_dom"), ("residual", "y_env"))}


@query
def ensemble_weighted2(spark, sf):
    c = _components(spark, sf)
    return EN.weighted_ensemble({k: c[k] for k in ("additive", "dominance")},
                                V.variance_weights(spark))


@query
def ensemble_weighted3(spark, sf):
    return EN.weighted_ensemble(_components(spark, sf), V.variance_weights(spark))


@query
def ensemble_equal(spark, sf):
    c = _components(spark, sf)
    return EN.equal_ensemble({k: c[k] for k in ("additive", "dominance")})


# ---------------------------------------------------------------- search, fit, predict (rows-only)

# The registered searches use a small space of their own, two candidates each, run as drawn; the analysis'
# full spaces and counts are the defaults of ``analysis.run``, and ``boosted_trees`` fits one model of that size.
SMALL_SPACE = dict(MD.BOOSTED_SPACE, n_estimators=(3, 6, "log-uniform"), max_depth=(2, 4, "log-uniform"))
SMALL_LEAF_SPACE = dict(MD.LEAF_WISE_SPACE, n_estimators=(3, 6, "log-uniform"), max_depth=(2, 4, "uniform"))
SMALL_BUDGET = MD.Budget(n_iter=2, batch=2)
# a candidate within the analysis' ranges but for the number of trees
DEEP_CANDIDATE = {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 3, "min_child_weight": 5, "subsample": 0.8,
                  "colsample_bytree": 0.7, "gamma": 0.05, "reg_alpha": 10, "reg_lambda": 2}


def _model_rows(spark, sf, geno):
    return (materialize(train_wide(spark, sf, geno), "model_rows"),
            materialize(test_wide(spark, sf, geno), "model_test_rows"))


def _binned(rows, test, fold_scheme, bins=None):
    train = MD.loyo(rows) if fold_scheme == "loyo" else MD.contiguous(rows, FOLD_ORDER)
    return MD.prepare_binned(train, test, MX.TRAIN_KEYS + ["fold"], MX.TEST_KEYS, bins)


def _fit_predict(spark, sf, geno, fits):
    """One prediction table per (fold scheme, space) in ``fits``, on shared training rows and bins."""
    rows, test = _model_rows(spark, sf, geno)
    out, bins = [], None
    for fold_scheme, space in fits:
        data = _binned(rows, test, fold_scheme, bins)
        bins = data.bins
        model, _ = MD.search_binned(data, space, SMALL_BUDGET)
        out.append(MD.predict_binned(model, data))
    return out


@query
def submission(spark, sf):
    """Boosted trees on metadata + weather + marker dosage, leave-one-year-out search of SMALL_SPACE."""
    return _fit_predict(spark, sf, "raw", [("loyo", SMALL_SPACE)])[0]


@query
def submission_env(spark, sf):
    """Boosted trees on metadata + weather only, 5 contiguous folds, search of SMALL_SPACE."""
    return _fit_predict(spark, sf, None, [("contiguous", SMALL_SPACE)])[0]


@query
def ensemble_learners(spark, sf):
    """Equal-weight average of a boosted and a leaf-wise model on the same matrix (small spaces)."""
    a, b = _fit_predict(spark, sf, "raw", [("loyo", SMALL_SPACE), ("contiguous", SMALL_LEAF_SPACE)])
    return EN.equal_ensemble({"boosted": a, "leaf_wise": b})


@query
def ensemble_codings(spark, sf):
    """Average of the fits on the additive and on the dominance coding (SMALL_SPACE), weighted by estimated variances."""
    preds = {name: _fit_predict(spark, sf, name, [("loyo", SMALL_SPACE)])[0] for name in ("additive", "dominance")}
    return EN.weighted_ensemble(preds, variance_components(spark, sf))


@query
def predict_given_trees(spark, sf):
    """Two given trees over three features of the test rows, NULLs sent where the splits say: base 25 plus leaf values."""
    test = MX.align_test(test_wide(spark, sf, None), ["lat", "m6", "w2"], MX.TEST_KEYS, [])
    bins = BI.Bins(["lat", "m6", "w2"], None, 0, [np.array(c) for c in ([45.5], [10.0, 20.0], [14.7])])
    model = BO.Forest(25.0, [
        BO.Tree(*map(np.array, ([1, 2, 0, 0, 0], [1, 0, 0, 0, 0], [True, False, False, False, False], [1, 3, -1, -1, -1],
                                [2, 4, -1, -1, -1], [0, 0, 2.25, 1.5, -0.5]))),
        BO.Tree(*map(np.array, ([0, 0, 1, 0, 0], [0, 0, 0, 0, 0], [False] * 5, [1, -1, 3, -1, -1], [2, -1, 4, -1, -1],
                                [0, -1.0, 0, 0.25, 0.75])))], BO.TreeParams())
    return BO.predict(test, model, bins, "_y").select("Env", "Hybrid", F.col("_y").alias("Yield_Mg_ha"))


@query
def search_scores(spark, sf):
    """The ledger of a leave-one-year-out search: (candidate, params, fold, n, mse) of every fit."""
    rows, _ = _model_rows(spark, sf, None)
    data = _binned(rows, None, "loyo")
    return MD.search_binned(data, SMALL_SPACE, SMALL_BUDGET)[1].table()


@query
def boosted_trees(spark, sf):
    """200 boosted trees of depth 3 with all penalties on every training row: the test rows' predictions."""
    rows, test = _model_rows(spark, sf, "raw")
    data = _binned(rows, test, "loyo")
    return MD.predict_binned(SE.refit(data.blocks, data.bins.n_bins, DEEP_CANDIDATE, MD.SEED), data)
