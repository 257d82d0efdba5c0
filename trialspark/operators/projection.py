"""Column selection, positional drops, casts and column alignment."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Project by name; names with spaces or ``#`` are quoted safely."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def select_positions(df: DataFrame, first: int, last: int) -> DataFrame:
    """Columns ``first..last`` (1-based, inclusive), like ``df[, first:last]``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[first - 1:last]])


def drop_positions(df: DataFrame, positions: Iterable[int]) -> DataFrame:
    """Drop columns by 1-based position, like ``df[, -c(2:6, 30:37)]``."""
    drop = {p - 1 for p in positions}
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if i not in drop])


def cast_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Cast string columns (default: all) to double; unparsable text becomes NULL."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cols = set(cols)
    return df.select(*[F.col(f"`{c}`").try_cast("double").alias(c) if c in cols
                       else F.col(f"`{c}`") for c in df.columns])


def align_columns(df: DataFrame, columns: Sequence[str], fill=0) -> DataFrame:
    """Reorder to ``columns``; drop extra columns; add missing ones filled with ``fill``.

    Existing NULLs are left untouched (only absent columns are filled).
    """
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(fill).alias(c) for c in columns])
