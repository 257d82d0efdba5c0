"""End-to-end analysis over the original delimited inputs.

Reads the trait, metadata, weather, EC and soil tables (train and test), the
submission template and the numeric genotype text; writes the same stage
outputs as the original analysis (outlier-flagged plots, phenotype table,
per-block feature tables, imputed genotypes, additive and dominance codings)
as tab text, and predictions as CSV.  Every step is one of the library's
DataFrame operators; stage outputs are written once and re-read.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.functions.keys import ENV_RECODE
from trialspark.operators import ensemble as EN
from trialspark.operators import genotype as G
from trialspark.operators import trial_stats as TS
from trialspark.operators import variance as VC
from trialspark.plans import features as FE
from trialspark.plans import matrices as MX
from trialspark.plans import model as MD
from trialspark.plans import phenotype as PH
from trialspark.session import materialize
from trialspark.sources import text as TX

# Fixed values of the original analysis.
META_KEEP = [
    "Env", "Treatment", "City", "Previous_Crop", "Irrigated",
    "Latitude_of_Field_Corner_#1 (lower left)", "Longitude_of_Field_Corner_#1 (lower left)",
    "Latitude_of_Field_Corner_#2 (lower right)", "Longitude_of_Field_Corner_#2 (lower right)",
    "Latitude_of_Field_Corner_#3 (upper right)", "Longitude_of_Field_Corner_#3 (upper right)",
    "Latitude_of_Field_Corner_#4 (upper left)", "Longitude_of_Field_Corner_#4 (upper left)",
    "Weather_Station_Latitude (in decimal numbers NOT DMS)",
    "Weather_Station_Longitude (in decimal numbers NOT DMS)",
]
META_TEXT = ["Treatment", "City", "Previous_Crop", "Irrigated"]
WEATHER_MEASURE_POSITIONS = (3, 18)
TRAIN_SOIL_DROP = list(range(2, 7)) + list(range(30, 38))
TEST_SOIL_DROP = list(range(2, 7)) + list(range(30, 37))
SOIL_EXCLUDE_YEARS = (2014, 2015)
TRAIT_TEXT = ["Env", "Hybrid", "Field_Location", "Experiment"]
TRAIT_INT = ["Year", "Replicate", "Block"]
# Our choice (the original ran one year pair per invocation): outlier-fit batches.
DEFAULT_OUTLIER_BATCHES = ((2014, 2015), (2016, 2017), (2018, 2019), (2020, 2021), (2022, 2023))


@dataclass
class Inputs:
    trait: str
    meta: str
    weather: str
    ec: str
    soil: str
    template: str
    test_meta: str
    test_weather: str
    test_ec: str
    test_soil: str
    genotype: str | None = None
    # batches computed elsewhere: outlier-free plots appended before the BLUEs, BLUE tables after them
    clean_plots: Sequence[str] = ()
    blues: Sequence[str] = ()


def _read(spark: SparkSession, path: str, strings: Sequence[str] = ("Env",),
          ints: Sequence[str] = (), order_col: str | None = "_row") -> DataFrame:
    schema, sep = TX.schema_from_header(spark, path, strings, ints)
    df = TX.read_delimited(spark, path, schema, sep=sep)
    if order_col:
        # file order for first-row-per-Env: file by name, block by offset, then the
        # running id, which grows along a block
        df = df.withColumn(order_col, F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                                               F.monotonically_increasing_id().alias("id")))
    return df


def read_inputs(spark: SparkSession, inp: Inputs, soil_text: Sequence[str] = ()) -> dict:
    t = {
        "trait": _read(spark, inp.trait, TRAIT_TEXT, TRAIT_INT, None),
        "meta": _read(spark, inp.meta, ["Env"] + META_TEXT, (), None),
        "weather": _read(spark, inp.weather, ["Env", "Date"], (), None),
        "ec": _read(spark, inp.ec),
        "soil": _read(spark, inp.soil, ["Env", *soil_text]),
        "template": _read(spark, inp.template, ["Env", "Hybrid"], (), None),
        "test_meta": _read(spark, inp.test_meta, ["Env"] + META_TEXT, (), None),
        "test_weather": _read(spark, inp.test_weather, ["Env", "Date"], (), None),
        "test_ec": _read(spark, inp.test_ec),
        "test_soil": _read(spark, inp.test_soil, ["Env", *soil_text]),
    }
    if inp.genotype:
        geno, markers = TX.read_genotype_text(spark, inp.genotype)
        t["genotype"], t["markers"] = geno, markers
    return t


def _batch_of(years: Sequence[Sequence[int]]):
    expr = None
    for i, ys in enumerate(years):
        cond = F.col("Year").isin(list(ys))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    # a year outside every listed batch is a batch of its own, below zero
    return F.coalesce(expr, -F.col("Year") - 1, F.lit(-1))


def phenotypes(trait: DataFrame, template: DataFrame,
               outlier_batches: Sequence[Sequence[int]] = DEFAULT_OUTLIER_BATCHES,
               years: Sequence[int] | None = PH.TRAIN_YEARS, extra_clean: Sequence[DataFrame] = (),
               extra_blues: Sequence[DataFrame] = ()):
    """(flagged plots, plots without outliers, phenotype table).

    Each outlier fit covers one group of years; years in no group are fitted
    one by one, so no plot is dropped for its year.
    """
    plots = PH.plot_rows(trait).withColumn("_batch", _batch_of(outlier_batches))
    flagged = materialize(TS.outlier_flag(plots, batch=("_batch",)).drop("_batch"), "flagged_plots")
    clean = TS.outlier_filter(flagged)
    for extra in extra_clean:
        clean = clean.unionByName(extra, allowMissingColumns=True)
    return flagged, clean, PH.phenotype_from_clean(clean, PH.test_locations(template), years, extra_blues)


def feature_tables(t: Mapping[str, DataFrame], pheno: DataFrame,
                   recode_map: Mapping[str, str] = ENV_RECODE) -> dict:
    """Train and test feature blocks keyed like the original output files."""
    locs = PH.test_locations(t["template"])
    w = t["weather"]
    lo, hi = WEATHER_MEASURE_POSITIONS
    measures = w.columns[lo - 1:hi]
    tw = t["test_weather"]
    tmeasures = tw.columns[lo - 1:hi]
    test = PH.test_keys(t["template"])
    return {
        "_WeatherByEnv": FE.weather_means(w, measures, recode_map, False),
        "_TestWeatherByEnv": FE.weather_means(tw, tmeasures, recode_map, True),
        "PhenoWeather": FE.features_weather(pheno, w, measures, recode_map),
        "PhenoEC": FE.features_ec(pheno, t["ec"], "_row", recode_map, keep_order=False),
        "PhenoMetal": FE.features_meta(pheno, t["meta"], locs, META_KEEP, META_TEXT),
        "PhenoSoil": FE.features_soil(pheno, t["soil"].drop("_row"), TRAIN_SOIL_DROP,
                                      SOIL_EXCLUDE_YEARS),
        "TestPhenoweather": FE.test_features_weather(test, tw, tmeasures, recode_map),
        "TestPhenoEC": FE.test_features_ec(test, t["test_ec"], "_row", keep_order=False),
        "TestPhenometal": FE.test_features_meta(test, t["test_meta"], locs, META_KEEP, META_TEXT),
        # the file-order column is appended last, so the positional drop never reaches it
        "TestPhenoSoil": FE.test_features_soil(test, t["test_soil"], TEST_SOIL_DROP,
                                               "_row").drop("_row"),
    }


def genotype_tables(geno: DataFrame) -> dict:
    """Imputed dosage, additive and dominance codings, each (Hybrid, array<double>)."""
    gi = materialize(G.impute_markers(G.scale_dosage(geno)), "genotype_imputed")
    freq = materialize(G.allele_freq(gi), "allele_frequencies")
    return {"Genotype_True": gi,
            "Genomic_addev_matrix": G.additive_coding(gi, out="dosage", freq=freq),
            "Genomic_dodev_matrix": G.dominance_coding(gi, out="dosage", freq=freq)}


@dataclass
class Recipe:
    """One model of the analysis: genotype table, learner, folds, search space, number of candidates.

    The learners differ in their space: a leaf-wise one has ``num_leaves``.
    """

    genotype: str | None
    kind: str = "boosted"
    folds: str = "loyo"
    space: Mapping | None = None
    n_iter: int = MD.N_ITER


#: The five models, with the analysis' own spaces, fold schemes and candidate counts.
RECIPES = {
    "normal": Recipe("Genotype_True", space=MD.BOOSTED_SPACE),
    "additive": Recipe("Genomic_addev_matrix", space=MD.BOOSTED_SPACE),
    "dominance": Recipe("Genomic_dodev_matrix", space=MD.BOOSTED_SPACE),
    "env": Recipe(None, folds="contiguous", space=MD.ENV_ONLY_SPACE, n_iter=MD.N_ITER_ENV),
    "leaf_wise": Recipe("Genotype_True", kind="leaf_wise", folds="contiguous", space=MD.LEAF_WISE_SPACE),
}
FOLD_ORDER = ["Year", "Field_Location", "Hybrid"]


def predict(blocks: Mapping[str, DataFrame], genotypes: Mapping[str, DataFrame], recipe: Recipe,
            ledger: str | None = None, batch: int = 4) -> DataFrame:
    """Train matrix (meta x weather x genotype) -> search -> fit -> written test predictions."""
    geno = genotypes[recipe.genotype] if recipe.genotype else None
    train = MX.assemble(blocks["PhenoMetal"], blocks["_WeatherByEnv"], geno,
                        years=PH.TRAIN_YEARS if geno is not None else None)
    test = MX.assemble(blocks["TestPhenometal"], blocks["_TestWeatherByEnv"], geno)
    train = MD.loyo(train) if recipe.folds == "loyo" else MD.contiguous(train, FOLD_ORDER)
    data = MD.prepare_binned(materialize(train, "train_rows"), test, MX.TRAIN_KEYS + ["fold"], MX.TEST_KEYS)
    model, _ = MD.search_binned(data, recipe.space, MD.Budget(recipe.n_iter, batch=batch), ledger=ledger)
    return MD.predict_binned(model, data)


def ensembles(preds: Mapping[str, DataFrame], weights: DataFrame | None) -> dict:
    """The combinations whose components are there: weighted (additive, dominance), weighted with the
    environment model as the residual component, and the plain average of the two learners."""
    out = {}
    parts = {"additive": "additive", "dominance": "dominance", "residual": "env"}
    if weights is not None and {"additive", "dominance"} <= set(preds):
        out["weighted2"] = EN.weighted_ensemble({k: preds[k] for k in ("additive", "dominance")}, weights)
        if "env" in preds:
            out["weighted3"] = EN.weighted_ensemble({k: preds[v] for k, v in parts.items()}, weights)
    if {"normal", "leaf_wise"} <= set(preds):
        out["learners"] = EN.equal_ensemble({k: preds[k] for k in ("normal", "leaf_wise")})
    return out


def run(spark: SparkSession, inp: Inputs, out_dir: str, recipes: Mapping[str, Recipe] = RECIPES,
        weights: DataFrame | None = None) -> dict:
    """Whole analysis; writes every stage output under ``out_dir`` and returns the tables.

    ``recipes`` are the models to fit (those with a genotype only if one is
    given); each search keeps its ledger under ``out_dir``, so a restarted run
    skips the fits it finished.  ``weights`` (component, V) are the variances
    of the weighted ensembles; without them they are estimated from the
    genotypes and the hybrids' mean phenotypes (``operators.variance``).
    """
    t = read_inputs(spark, inp)
    clean_extra = [_read(spark, p, [*TRAIT_TEXT, "Hybrid_Env"], TRAIT_INT, None) for p in inp.clean_plots]
    blue_extra = [PH.phenotype_from_external(_read(spark, p, ["Hybrid", "Field.Location", "Field_Location", "Env"],
                                                   ["Year"], None)).drop("Hybrid_Env") for p in inp.blues]
    flagged, clean, pheno = phenotypes(t["trait"], t["template"], extra_clean=clean_extra, extra_blues=blue_extra)
    TX.write_delimited(flagged, os.path.join(out_dir, "Pheno_data_Outlier"))
    TX.write_delimited(clean, os.path.join(out_dir, "Pheno_data_without_Outlier"))
    TX.write_delimited(pheno, os.path.join(out_dir, "Phenotype_Blue"))
    blocks = feature_tables(t, pheno)
    for name, df in blocks.items():
        if not name.startswith("_"):
            TX.write_delimited(df, os.path.join(out_dir, name))
    out = {"flagged": flagged, "clean": clean, "phenotype": pheno, **blocks}
    genotypes = {}
    if "genotype" in t:
        genotypes = genotype_tables(t["genotype"])
        for name, df in genotypes.items():
            TX.write_genotype_text(df, t["markers"], os.path.join(out_dir, name))
        out.update(genotypes)
    if weights is None and genotypes:
        weights = VC.variance_components(genotypes["Genotype_True"],
                                         pheno.groupBy("Hybrid").agg(F.avg("Yield_Mg_ha").alias("y")))
    preds = {name: predict(blocks, genotypes, r, os.path.join(out_dir, f"search_{name}")) for name, r in recipes.items()
             if r.genotype is None or r.genotype in genotypes}
    preds |= ensembles(preds, weights)
    for name, df in preds.items():
        TX.write_csv(df, os.path.join(out_dir, f"predictions_{name}"))
    out["predictions"] = preds
    return out
