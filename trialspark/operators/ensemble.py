"""Combining component-model predictions.

All components are stacked into one long table (component, key, prediction)
and combined by key: a component that predicts a key more than once counts
with its mean, and only keys that every component predicts are kept (presence
is tested per component, not by a row count).  The weight table is cut to the
given components and checked to have one row each, which bounds its broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("Env", "Hybrid")


def stack_predictions(preds: Mapping[str, DataFrame], value: str = "Yield_Mg_ha",
                      keys: Sequence[str] = KEYS) -> DataFrame:
    out = None
    for name, df in preds.items():
        part = df.select(*keys, F.col(value).cast("double").alias("_yhat"),
                         F.lit(name).alias("component"))
        out = part if out is None else out.unionByName(part)
    return out


def _per_component(preds: Mapping[str, DataFrame], value: str, keys: Sequence[str]) -> DataFrame:
    """One row per key and component: the mean of the component's predictions of the key."""
    return (stack_predictions(preds, value, keys).groupBy(*keys, "component")
            .agg(F.avg("_yhat").alias("_yhat")))


def _in_all(each: DataFrame, keys: Sequence[str], n: int, combined) -> DataFrame:
    """Combine per key, keeping the keys that all ``n`` components predict."""
    return (each.groupBy(*keys).agg(combined, F.count("_yhat").alias("_k"))
            .filter(F.col("_k") == n).drop("_k"))


def weighted_ensemble(preds: Mapping[str, DataFrame], weights: DataFrame,
                      value: str = "Yield_Mg_ha", keys: Sequence[str] = KEYS,
                      weight_col: str = "V") -> DataFrame:
    """sum_c w_c * yhat_c with w_c = V_c / sum(V) over the given components; all V zero: equal weights."""
    comps = list(preds)
    w = weights.filter(F.col("component").isin(comps)).select("component", weight_col)
    rows = w.groupBy("component").count().limit(len(comps) + 1).collect()  # at most one row per component
    if {r["component"]: r["count"] for r in rows} != dict.fromkeys(comps, 1):
        raise ValueError(f"the weights need exactly one row for each of {comps}")
    total = w.agg(F.sum(weight_col).alias("_tot"))
    w = w.crossJoin(F.broadcast(total)).select(
        "component", F.when(F.col("_tot") == 0, F.lit(1.0 / len(comps)))
        .otherwise(F.try_divide(weight_col, "_tot")).alias("_w"))
    each = _per_component(preds, value, keys).join(F.broadcast(w), "component")
    return _in_all(each, keys, len(preds), F.sum(F.col("_w") * F.col("_yhat")).alias(value))


def equal_ensemble(preds: Mapping[str, DataFrame], value: str = "Yield_Mg_ha",
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Plain average of the component predictions."""
    return _in_all(_per_component(preds, value, keys), keys, len(preds), F.avg("_yhat").alias(value))
