"""Per-environment feature blocks joined onto phenotype (train) or template (test) rows.

Each block is reduced to at most the rows the reference keeps *before* the
join (aggregate or first-per-Env), written, and left-joined on ``Env``.
Block tables have about one row per environment; the written size decides
between a broadcast, which leaves the rows where they are, and a sort-merge join.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame

from trialspark.functions.keys import recode
from trialspark.operators import aggregate as A
from trialspark.operators import filters as FL
from trialspark.operators import projection as P
from trialspark.operators.impute import impute_group_mean
from trialspark.operators.joins import join_written
from trialspark.plans.phenotype import add_location_year


def weather_means(weather: DataFrame, measures: Sequence[str], recode_map: Mapping[str, str],
                  na_rm: bool) -> DataFrame:
    """Recode sub-site environments, then mean of each measure per Env."""
    w = weather.withColumn("Env", recode("Env", recode_map))
    return A.group_mean(w, "Env", measures, na_rm=na_rm)


def features_weather(pheno: DataFrame, weather: DataFrame, measures: Sequence[str],
                     recode_map: Mapping[str, str], na_rm: bool = False) -> DataFrame:
    """Phenotype rows + weather means (NULL-propagating for train by default)."""
    return join_written(pheno, weather_means(weather, measures, recode_map, na_rm), "Env", "left", "weather_means")


def ec_first(ec: DataFrame, recode_map: Mapping[str, str] | None, order: str) -> DataFrame:
    e = ec.withColumn("Env", recode("Env", recode_map)) if recode_map else ec
    return A.first_per_key(e, "Env", order)


def features_ec(pheno: DataFrame, ec: DataFrame, order: str,
                recode_map: Mapping[str, str] | None = None,
                max_missing: float = 0.5, keep_order: bool = True) -> DataFrame:
    """Phenotype rows + first EC row per Env, then drop rows missing >= half their cells.

    ``keep_order=False`` drops the order column before the filter (when it is a
    file-position column added by the reader rather than a column of the table).
    """
    block = ec_first(ec, recode_map, order)
    if not keep_order:
        block = block.drop(order)
    joined = join_written(pheno, block, "Env", "left", "ec_first")
    return FL.drop_sparse_rows(joined, max_missing)


def meta_block(meta: DataFrame, locations: DataFrame, keep: Sequence[str] | None = None,
               drop: Sequence[str] = ()) -> DataFrame:
    """Metadata restricted to test locations; ``keep`` columns (default all), minus ``drop``."""
    m = add_location_year(meta)
    m = FL.semi_join_keys(m, locations, "Field_Location")
    keep = list(keep) if keep is not None else [c for c in meta.columns]
    m = P.select_columns(m, keep)
    return m.drop(*drop)


def features_meta(pheno: DataFrame, meta: DataFrame, locations: DataFrame,
                  keep: Sequence[str] | None = None, drop: Sequence[str] = (),
                  impute_by: str = "Field_Location", max_missing: float = 0.5,
                  impute_exclude: Sequence[str] = ("Yield_Mg_ha",)) -> DataFrame:
    """Phenotype rows + metadata; drop sparse rows; impute by location mean (train)."""
    joined = join_written(pheno, meta_block(meta, locations, keep, drop), "Env", "left", "meta_block")
    joined = FL.drop_sparse_rows(joined, max_missing)
    return impute_group_mean(joined, impute_by, exclude=impute_exclude)


def soil_block(soil: DataFrame, drop_positions: Iterable[int]) -> DataFrame:
    """Split Env into location/year columns, then drop columns by 1-based position."""
    return P.drop_positions(add_location_year(soil), drop_positions)


def features_soil(pheno: DataFrame, soil: DataFrame, drop_positions: Iterable[int],
                  exclude_years: Iterable[int] = (2014, 2015), max_missing: float = 0.5,
                  impute_by: str = "Field_Location",
                  impute_exclude: Sequence[str] = ("Yield_Mg_ha",)) -> DataFrame:
    """Phenotype rows + soil (not de-duplicated), drop years and sparse rows, impute."""
    joined = join_written(pheno, soil_block(soil, drop_positions), "Env", "left", "soil_block")
    joined = FL.filter_not_in(joined, "Year", exclude_years)
    joined = FL.drop_sparse_rows(joined, max_missing)
    return impute_group_mean(joined, impute_by, exclude=impute_exclude)


# ---- test side: no imputation, NULL-skipping weather means --------------------------

def test_features_weather(test: DataFrame, weather: DataFrame, measures: Sequence[str],
                          recode_map: Mapping[str, str]) -> DataFrame:
    return features_weather(test, weather, measures, recode_map, na_rm=True)


def test_features_ec(test: DataFrame, ec: DataFrame, order: str,
                     max_missing: float = 0.5, keep_order: bool = True) -> DataFrame:
    return features_ec(test, ec, order, None, max_missing, keep_order)


def test_features_meta(test: DataFrame, meta: DataFrame, locations: DataFrame,
                       keep: Sequence[str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    return join_written(test, meta_block(meta, locations, keep, drop), "Env", "left", "meta_block")


def test_features_soil(test: DataFrame, soil: DataFrame, drop_positions: Iterable[int],
                       order: str) -> DataFrame:
    block = A.first_per_key(soil_block(soil, drop_positions), "Env", order)
    return join_written(test, block, "Env", "left", "soil_first")

