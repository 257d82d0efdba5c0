"""Model matrices: train/test rows with environment features and marker codings.

Train: metadata rows (imputed) joined with the weather means on ``Env``,
left-joined with the genotype table on ``Hybrid``, restricted to the training
years.  Test: the same, then aligned to the train feature columns.

The weather block holds one row per environment and is attached by ``Env``,
not by the row keys: every join is many-to-one, each plot row appears once
(also where a site repeats a hybrid, or a template has one hybrid at two
sub-sites), and no rows are shuffled to attach a small table.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.operators import filters as FL
from trialspark.operators.genotype import MAX_BROADCAST_MARKERS, marker_vector, stat_blocks
from trialspark.operators.joins import join_written
from trialspark.operators.markers import from_blocks, numbered
from trialspark.operators.projection import align_columns
from trialspark.session import materialize

TRAIN_KEYS = ["Hybrid", "Year", "Field_Location", "Env", "Hybrid_Env", "Yield_Mg_ha"]
TEST_KEYS = ["Hybrid", "Year", "Field_Location", "Env", "Hybrid_Field", "Yield_Mg_ha"]


def assemble(meta_rows: DataFrame, weather_by_env: DataFrame, geno: DataFrame | None,
             years: Iterable[int] | None = None, geno_col: str = "dosage") -> DataFrame:
    """Join the blocks: metadata rows, weather (one row per Env), genotype (one row per hybrid)."""
    out = join_written(meta_rows, weather_by_env, "Env", "left", "weather_by_env")
    if geno is not None:
        out = out.join(geno.select("Hybrid", F.col(geno_col).alias("geno")), "Hybrid", "left")
    if years is not None:
        out = FL.filter_in(out, "Year", years)
    return out


def feature_columns(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """Scalar feature columns: everything except keys and the genotype array."""
    return [c for c in df.columns if c not in set(keys) and c != "geno"]


def to_long(df: DataFrame, id_cols: Sequence[str], scalar_cols: Sequence[str],
            array_col: str | None = "geno", prefix: str = "g") -> DataFrame:
    """(id..., feature, value) rows: one per scalar feature and one per array element."""
    parts = [F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                       for c in scalar_cols])] if scalar_cols else []
    if array_col and array_col in df.columns:
        parts.append(F.coalesce(F.transform(array_col, lambda x, i: F.struct(
            F.concat(F.lit(prefix), i.cast("string")).alias("feature"),
            x.cast("double").alias("value"))), F.array().cast(
                "array<struct<feature:string,value:double>>")))
    feats = F.concat(*parts) if len(parts) > 1 else parts[0]
    return df.select(*id_cols, F.explode(feats).alias("_f")).select(*id_cols, "_f.feature", "_f.value")


def align_test(test: DataFrame, train_columns: Sequence[str], keys_test: Sequence[str],
               keys_train: Sequence[str]) -> DataFrame:
    """Test rows with the train feature columns (missing -> 0), keys kept in front.

    Only the names of the train columns are needed, never its rows.
    """
    feats = [c for c in train_columns if c not in set(keys_train)]
    return align_columns(test, list(keys_test) + feats, fill=0)


def fill_missing_genotypes(df: DataFrame, marker_means: DataFrame,
                           max_markers: int = MAX_BROADCAST_MARKERS) -> DataFrame:
    """Rows whose hybrid has no genotype get the marker means (i, mean) instead of NULL.

    The means are written and counted: up to ``max_markers`` they travel as
    one broadcast row; beyond it the rows without genotype take the means
    block by block in a join and are put together again.
    """
    st = materialize(marker_means.select("i", F.col("mean").cast("double").alias("_stat")), "marker_means")
    if st.count() <= max_markers:
        vec = marker_vector(st, "_stat", "_means")
        return df.crossJoin(F.broadcast(vec)).withColumn("geno", F.coalesce("geno", "_means")).drop("_means")
    rows = numbered(df, "_rid")
    blocks = materialize(stat_blocks(st), "mean_blocks")
    n = blocks.agg(F.max("block").alias("last")).first()["last"]
    wanted = rows.filter("geno is null").select("_rid", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("block"))
    filled = from_blocks(wanted.join(blocks.hint("merge"), "block"), "_rid", "_stat")
    return (rows.join(filled, "_rid", "left").withColumn("geno", F.coalesce("geno", "_stat"))
            .drop("_rid", "_stat"))


def ml_ready(df: DataFrame, scalar_cols: Sequence[str], fill: dict[str, float],
             geno_len: int | None = None) -> DataFrame:
    """Replace NULL features by ``fill`` (train means) and add 0/1 missing indicators.

    Spark tree learners reject NaN, while the reference passes missing values
    to learners that route them; imputation plus an indicator keeps that
    information.  A hybrid without genotype gets an all-zero array.
    """
    out = df
    for c in scalar_cols:
        out = out.withColumn(f"{c}__na", F.col(c).isNull().cast("double")) \
                 .withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(fill.get(c, 0.0))))
    if "geno" in df.columns:
        zeros = F.array_repeat(F.lit(0.0), geno_len or 0)
        out = out.withColumn("geno", F.transform(F.coalesce("geno", zeros),
                                                 lambda x: F.coalesce(x, F.lit(0.0))))
        out = out.withColumn("geno_vec", array_to_vector("geno"))
    return out
