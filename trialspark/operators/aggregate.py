"""Aggregations: group means, distinct counts, first row per key, profiles.

Every aggregate is a ``groupBy`` so Spark runs a map-side partial aggregate
before the shuffle: a key holding a third of the rows reaches the reducer as
one partial row per map task, never as raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.operators.ordering import with_weighted_start


def group_mean(df: DataFrame, by: Sequence[str] | str, cols: Sequence[str],
               na_rm: bool = False) -> DataFrame:
    """Mean of ``cols`` per group.

    ``na_rm=False`` propagates missing values (any NULL in the group -> NULL),
    ``na_rm=True`` skips them (an all-NULL group -> NULL).
    """
    by = [by] if isinstance(by, str) else list(by)
    aggs = []
    for c in cols:
        if na_rm:
            aggs.append(F.avg(c).alias(c))
        else:
            aggs.append(F.when(F.count(c) == F.count(F.lit(1)), F.avg(c)).alias(c))
    return df.groupBy(*by).agg(*aggs)


def first_per_key(df: DataFrame, key: Sequence[str] | str, order: str) -> DataFrame:
    """First row per key in ``order`` order, all columns kept (``distinct(.keep_all)``).

    ``order`` must be a non-null column that gives the intended row order (the
    file order of the source); ties are broken by the remaining columns.  A
    ``min`` over a struct led by ``order`` is a partial aggregate, so a hot key
    is reduced map-side instead of sorted in one task.
    """
    key = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in key and c != order]
    first = F.min(F.struct(F.col(order).alias(order), *[F.col(c) for c in rest])).alias("_first")
    out = df.groupBy(*key).agg(first)
    return out.select(*[F.col(c) if c in key else F.col(f"_first.{c}").alias(c)
                        for c in df.columns])


def distinct_values(df: DataFrame, cols: Sequence[str] | str) -> DataFrame:
    cols = [cols] if isinstance(cols, str) else list(cols)
    return df.select(*cols).distinct()


def _numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def unpivot_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value double) rows for ``cols`` (NULL values kept)."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
        for c in cols])).alias("_u")).select("_u.column", "_u.value")


def column_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``summary()`` per numeric column: min, q1, median, mean, q3, max, na_count.

    Quantiles are exact, interpolated linearly between order statistics (R
    type 7).  Values are first counted per (column, value) with a partial
    aggregate (a repeated value, however hot, becomes one row), the distinct
    values are range-sorted, and each gets the rank interval it covers; the
    needed order statistics are picked from those intervals.  Nothing is
    collected into one task.  Output one row per column.
    """
    cols = list(cols) if cols else _numeric_columns(df)
    long = unpivot_values(df, cols)
    basic = long.groupBy("column").agg(
        F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"),
        F.count("value").alias("_n"),
        F.sum(F.col("value").isNull().cast("long")).alias("na_count"))
    counts = (long.filter(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("_cnt")))
    ranked = with_weighted_start(counts, ["column", "value"], "_cnt", "_start")
    col_start = ranked.groupBy("column").agg(F.min("_start").alias("_c0"))

    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    need = basic.select("column", *[
        ((F.col("_n") - 1).cast("double") * p).alias(f"_h_{k}") for k, p in probs.items()])
    need = need.select("column", *[f"_h_{k}" for k in probs], F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor(f"_h_{k}"), F.ceil(f"_h_{k}")) for k in probs]))).alias("_ranks"))
    # rows whose rank interval [r0, r0 + cnt) contains a needed rank (<= 6 per column)
    # col_start and need have one row per profiled column: bounded, broadcast
    picked = (ranked.join(F.broadcast(col_start), "column")
              .join(F.broadcast(need.select("column", "_ranks")), "column")
              .select("column", "value", (F.col("_start") - F.col("_c0")).alias("_r0"), "_cnt",
                      "_ranks")
              .select("column", "value", F.explode(F.filter(
                  "_ranks", lambda r: (r >= F.col("_r0")) & (r < F.col("_r0") + F.col("_cnt"))))
                      .alias("_r")))
    order_stats = picked.groupBy("column").agg(
        F.map_from_entries(F.collect_list(F.struct("_r", "value"))).alias("_os"))
    out = basic.join(need, "column").join(order_stats, "column", "left")
    for k in probs:
        h = F.col(f"_h_{k}")
        lo = F.element_at("_os", F.floor(h))
        hi = F.element_at("_os", F.ceil(h))
        out = out.withColumn(k, lo + (h - F.floor(h)) * (hi - lo))
    return out.select("column", "min", "q1", "median", "mean", "q3", "max",
                      F.col("na_count").cast("long").alias("na_count"))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: number of NULL and non-NULL cells (one row per column)."""
    cols = list(cols) if cols else df.columns
    agg = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols],
                 F.count(F.lit(1)).alias("_rows"))
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("n_null"),
                 (F.col("_rows") - F.coalesce(F.col(c), F.lit(0))).alias("n_not_null"))
        for c in cols])).alias("_s")).select("_s.*")


def array_null_cells(df: DataFrame, array_col: str) -> DataFrame:
    """Count of NULL and non-NULL cells of an array column over all rows."""
    nulls = F.size(F.filter(array_col, lambda x: x.isNull()))
    return df.agg(F.sum(nulls).cast("long").alias("n_null"),
                  F.sum(F.size(array_col) - nulls).cast("long").alias("n_not_null"))


def table_shape(df: DataFrame, name: str = "") -> DataFrame:
    """One row: table name, number of rows, number of columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_cols"))
