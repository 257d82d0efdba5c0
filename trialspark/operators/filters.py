"""Row filters with R-compatible NULL handling."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.operators.joins import join_written


def filter_in(df: DataFrame, col: str, values: Iterable, cast: str | None = "int") -> DataFrame:
    """Keep rows whose ``col`` is in ``values`` (``%in%``); values are cast first."""
    values = list(values)
    c = F.col(col).cast(cast) if cast else F.col(col)
    return df.filter(c.isin(values))


def filter_not_in(df: DataFrame, col: str, values: Iterable, cast: str | None = "int") -> DataFrame:
    """Drop rows whose ``col`` is in ``values``; NULL keys are kept (``!x %in% v`` is TRUE for NA)."""
    values = list(values)
    c = F.col(col).cast(cast) if cast else F.col(col)
    return df.filter(c.isNull() | ~c.isin(values))


def missing_fraction(cols: Sequence[str]):
    """Fraction of NULL cells among ``cols`` of a row."""
    total = None
    for c in cols:
        term = F.col(c).isNull().cast("int")
        total = term if total is None else total + term
    return total / F.lit(len(cols))


def drop_sparse_rows(df: DataFrame, max_missing: float = 0.5) -> DataFrame:
    """Keep rows whose missing fraction over *all* columns is strictly below ``max_missing``."""
    return df.filter(missing_fraction(df.columns) < F.lit(max_missing))


def drop_missing(df: DataFrame, col: str) -> DataFrame:
    """Drop rows with a missing value in ``col``."""
    return df.filter(F.col(col).isNotNull())


def exclude_pattern(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Drop rows whose ``col`` matches the regular expression; NULL rows are kept."""
    return df.filter(F.coalesce(~F.col(col).rlike(pattern), F.lit(True)))


def semi_join_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Keep rows whose key occurs in ``keys`` (``x %in% unique(keys)``).

    The key side is de-duplicated first (partial aggregate), so the join build
    side is the set of distinct keys, written and broadcast under a measured size.
    """
    on = [on] if isinstance(on, str) else list(on)
    return join_written(df, keys.select(*on).distinct(), on, "left_semi", "semi_keys")
