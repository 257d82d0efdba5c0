"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names derived from ``names`` that no column of ``df`` has (Spark compares them without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` less the columns an operator is about to add, so that clashing input columns are replaced."""
    gone = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def row_key(*cols: str | Column) -> list[Column]:
    """Two 64-bit hashes (128 bits together) of the given columns, nulls included."""
    parts = []
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        parts += [c.isNull(), c]
    return [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)]
