"""Group-mean imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.operators.joins import join_written


def fractional_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))
            and f.name not in set(exclude)]


def impute_group_mean(df: DataFrame, group: str | Sequence[str] = "Field_Location",
                      cols: Sequence[str] | None = None,
                      exclude: Sequence[str] = ("Yield_Mg_ha",)) -> DataFrame:
    """Fill NULLs of each column with that column's mean within the same group.

    Means are taken over the rows of ``df`` itself (after any joins, so they
    are weighted by those rows).  ``cols`` defaults to every fractional column
    except ``exclude`` (the target by default).  Groups whose column is all
    NULL stay NULL.

    Plan: one ``groupBy(group)`` with partial aggregation for every column at
    once; the means (one row per group) are written, measured and broadcast
    under the bound, so the rows are not shuffled; beyond it the join is a
    sort-merge join (with skewed partitions split).  No window is used, so a
    hot group never sits in one task.
    """
    group = [group] if isinstance(group, str) else list(group)
    cols = list(cols) if cols is not None else fractional_columns(df, exclude)
    if not cols:
        return df
    means = df.groupBy(*group).agg(*[F.avg(c).alias(f"_mean_{i}") for i, c in enumerate(cols)])
    joined = join_written(df, means, group, "left", "group_means")
    pos = {c: i for i, c in enumerate(cols)}
    return joined.select(*[
        F.coalesce(F.col(c), F.col(f"_mean_{pos[c]}")).alias(c) if c in pos else F.col(c)
        for c in df.columns])
