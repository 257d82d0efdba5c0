"""Phenotype table: outlier removal -> per-site BLUEs / single-replicate rows -> filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.keys import build_key, split_key
from trialspark.operators import filters as FL
from trialspark.operators import trial_stats as TS
from trialspark.session import materialize

# Fixed value: the phenotype table's columns.
PHENO_COLUMNS = ["Hybrid", "Field_Location", "Year", "Env", "Hybrid_Env", "Yield_Mg_ha"]
# Fixed value: training years kept after the phenotype table is built.
TRAIN_YEARS = (2019, 2020, 2021, 2022, 2023)


def plot_rows(trial: DataFrame, trait: str = "Yield_Mg_ha") -> DataFrame:
    """Plot rows with a trait value and the ``Hybrid|Env`` key."""
    return (FL.drop_missing(trial, trait)
            .withColumn("Hybrid_Env", build_key("Hybrid", "Env", sep="|")))


def test_keys(template: DataFrame) -> DataFrame:
    """Submission template with Field_Location, Year and ``Hybrid_Field`` keys.

    Output: Hybrid, Field_Location, Year, Env, Hybrid_Field, Yield_Mg_ha.
    """
    loc, year = split_key("Env")
    t = template.select("*", loc, year.try_cast("int").alias("Year"))
    return t.select("Hybrid", "Field_Location", "Year", "Env",
                    build_key("Hybrid", "Field_Location").alias("Hybrid_Field"), "Yield_Mg_ha")


def test_locations(template: DataFrame) -> DataFrame:
    """Distinct field locations of the test environments."""
    return test_keys(template).select("Field_Location").distinct()


def phenotype_table(trial: DataFrame, locations: DataFrame,
                    years: Iterable[int] | None = TRAIN_YEARS,
                    outlier_batch: Sequence[str] = ("Year",),
                    extra_clean: Sequence[DataFrame] = (),
                    extra_blues: Sequence[DataFrame] = (),
                    trait: str = "Yield_Mg_ha") -> DataFrame:
    """Outlier-free per-site BLUEs (replicated sites) and plot rows (single-replicate sites).

    ``extra_clean`` are outlier-free plot batches computed elsewhere, appended
    before the BLUE step; ``extra_blues`` are BLUE tables appended after it.
    The result is restricted to hybrids without the text ``Replicate``, to the
    given ``locations`` and to ``years``.

    Actions: the two fixed-effect fits, the outlier-free rows and the final
    table are written to the shared checkpoint folder (the stage boundary at
    which the analysis writes and re-reads its phenotype file).
    """
    flagged = TS.outlier_flag(plot_rows(trial, trait), trait=trait, batch=outlier_batch)
    clean = TS.outlier_filter(flagged).select("Year", "Field_Location", "Hybrid", "Env", "Replicate", trait)
    if years is not None:  # the BLUEs are fitted site by site, so the other years have no part in them
        clean = FL.filter_in(clean, "Year", years)
    clean = materialize(clean, "clean_plots")
    for extra in extra_clean:
        clean = clean.unionByName(extra, allowMissingColumns=True)
    return phenotype_from_clean(clean, locations, years, extra_blues, trait)


def phenotype_from_clean(clean: DataFrame, locations: DataFrame,
                         years: Iterable[int] | None = TRAIN_YEARS,
                         extra_blues: Sequence[DataFrame] = (),
                         trait: str = "Yield_Mg_ha") -> DataFrame:
    """BLUEs (replicated sites) and plot rows (single-replicate sites) of outlier-free plots,
    keyed, filtered and written to the shared checkpoint folder."""
    replicated, single = TS.blues_and_single_rep(clean, trait)
    blues = replicated.unionByName(single)
    for extra in extra_blues:
        blues = blues.unionByName(extra.select(*blues.columns))
    out = blues.withColumn("Hybrid_Env", build_key("Hybrid", "Env")).select(*PHENO_COLUMNS)
    out = FL.exclude_pattern(out, "Hybrid", "Replicate")
    out = FL.semi_join_keys(out, locations, "Field_Location")
    if years is not None:
        out = FL.filter_in(out, "Year", years)
    return materialize(out, "phenotype")


def phenotype_from_external(df: DataFrame) -> DataFrame:
    """Rename dotted columns of an external BLUE table (``Field.Location`` etc.)."""
    ren = {c: c.replace(".", "_") for c in df.columns if "." in c}
    out = df.withColumnsRenamed(ren) if ren else df
    return out.withColumn("Hybrid_Env", build_key("Hybrid", "Env")).select(*PHENO_COLUMNS)


def add_location_year(df: DataFrame, env: str = "Env") -> DataFrame:
    """Insert Field_Location and Year (text, as split) right after ``env``."""
    loc, year = split_key(env)
    cols = []
    for c in df.columns:
        cols.append(F.col(f"`{c}`"))
        if c == env:
            cols += [loc, year]
    return df.select(*cols)
