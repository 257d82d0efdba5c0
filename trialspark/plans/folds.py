"""Cross-validation folds and fold scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from trialspark.operators.joins import join_written
from trialspark.operators.ordering import with_row_index


def leave_one_group_out(df: DataFrame, group: str = "Year", fold: str = "fold") -> DataFrame:
    """Fold id = 0-based rank of the row's group among the distinct groups.

    Distinct groups are few (years); ranking them is a window over that tiny
    table, which is written and joined back by its measured size.
    """
    groups = df.select(group).distinct()
    ranked = groups.select(group, (F.dense_rank().over(Window.orderBy(group)) - 1).alias(fold))
    return join_written(df, ranked, group, "inner", "fold_groups")


def contiguous_folds(df: DataFrame, order: Sequence[str], k: int = 5,
                     fold: str = "fold") -> DataFrame:
    """k unshuffled contiguous folds in ``order`` (sizes differ by at most one,
    larger folds first), like ``KFold(k)`` on rows in that order.

    Positions come from a distributed global row index, not a single-partition window.
    """
    idx = with_row_index(df, order, "_pos")
    n = df.agg(F.count(F.lit(1)).alias("_nrows"))
    j = idx.crossJoin(F.broadcast(n))  # one row
    q = F.floor(F.col("_nrows") / k)
    r = F.col("_nrows") - q * k
    big = r * (q + 1)
    fid = F.when(F.col("_pos") < big, F.floor(F.col("_pos") / (q + 1))) \
           .otherwise(r + F.floor((F.col("_pos") - big) / q))
    return j.withColumn(fold, fid.cast("int")).drop("_pos", "_nrows")


def mean_model_cv(df: DataFrame, label: str, fold: str = "fold") -> DataFrame:
    """Score the training-mean predictor per fold: (fold, n, mse).

    For each fold the prediction is the mean label of all other folds; the
    MSE of the held-out rows is reported per fold (average over folds = CV MSE).
    """
    per = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("_fold_sum"))
    tot = per.agg(F.sum("n").alias("_tot_n"), F.sum("_fold_sum").alias("_tot_sum"))
    means = per.crossJoin(F.broadcast(tot)).select(
        fold, "n", F.try_divide(F.col("_tot_sum") - F.col("_fold_sum"), F.col("_tot_n") - F.col("n")).alias("_m"))
    scored = df.join(F.broadcast(means), fold)  # one row per fold
    err = F.col(label) - F.col("_m")
    return scored.groupBy(fold, "n").agg(F.avg(err * err).alias("mse"))
