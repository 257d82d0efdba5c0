"""Trial-domain views over the benchmark parquet tables.

The benchmark ships TPC-H-like tables; these views give them the shape of the
field-trial inputs (plots, weather, metadata, genotypes, submission template,
component predictions).  Each view is a pure projection / aggregate of a
whole table, so work grows with the scale factor, and every view has a SQL
twin in ``oracle_sql.py`` that DuckDB evaluates independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.functions.keys import build_key
from trialspark.session import materialize

# Fixed values of the fixture mapping: 40 hybrids, 8 locations, years shifted
# by +23 (1995-2001 -> 2018-2024, so the test year 2024 is outside the training years), missing yield every 29th order, +60 spike
# every 53rd order, single-replicate location L7, fully missing metadata at L6.
N_HYBRIDS = 40
N_LOCATIONS = 8
YEAR_SHIFT = 23
SINGLE_REP_LOCATION = 7
TEST_SHIP_YEAR = 2001
# component variances for the weighted ensembles (additive, dominance, residual)
VARIANCE_WEIGHTS = [("additive", 4.0), ("dominance", 1.0), ("residual", 3.0)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _loc(col: str):
    return F.col(col) % N_LOCATIONS


def _year(col: str):
    return (F.year(col) + YEAR_SHIFT).cast("int")


def _plots(li: DataFrame, replicate, hybrid=None) -> DataFrame:
    loc, yr = _loc("l_suppkey"), _year("l_shipdate")
    return li.select(
        build_key(F.lit("H"), F.col("l_partkey") % N_HYBRIDS if hybrid is None else hybrid, sep="").alias("Hybrid"),
        build_key(F.lit("L"), loc, sep="").alias("Field_Location"),
        yr.alias("Year"),
        F.concat(F.lit("L"), loc.cast("string"), F.lit("_"), yr.cast("string")).alias("Env"),
        replicate.alias("Replicate"),
        (F.col("l_orderkey") % 4).alias("Block"),
        F.when(F.col("l_orderkey") % 29 == 0, F.lit(None).cast("double"))
         .when(F.col("l_orderkey") % 53 == 0, F.col("l_quantity") + 60)
         .otherwise(F.col("l_quantity")).alias("Yield_Mg_ha"),
    )


def trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plot rows: Hybrid, Field_Location, Year, Env, Replicate, Block, Yield_Mg_ha."""
    rep = (F.when(_loc("l_suppkey") == SINGLE_REP_LOCATION, F.lit(1))
            .otherwise(F.col("l_linenumber") % 2 + 1))
    return _plots(table(spark, sf_dir, "lineitem"), rep)


def trial_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same plots with one hybrid per part: cells grow with the data, and some hybrids have no genotype."""
    rep = (F.when(_loc("l_suppkey") == SINGLE_REP_LOCATION, F.lit(1))
            .otherwise(F.col("l_linenumber") % 2 + 1))
    return _plots(table(spark, sf_dir, "lineitem"), rep, F.col("l_partkey"))


def trial_multi_rep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same plots with three replicate levels everywhere (two replicate contrasts)."""
    return _plots(table(spark, sf_dir, "lineitem"), F.col("l_linenumber") % 3 + 1)


def weather_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily-weather-like rows: raw Env (with sub-site codes), ord, w1, w2.

    Also the EC and soil fixture (first row per Env in ``ord`` order).
    """
    o = table(spark, sf_dir, "orders")
    loc = _loc("o_custkey")
    oy = F.year("o_orderdate")
    yr = (oy + YEAR_SHIFT).cast("string")
    sub = (loc == 1) & oy.isin(1996, 1998)
    env = F.when(sub, F.concat(F.lit("L1_"), (1 + F.col("o_orderkey") % 2).cast("string"),
                               F.lit("_"), yr)) \
           .otherwise(F.concat(F.lit("L"), loc.cast("string"), F.lit("_"), yr))
    return o.select(
        env.alias("Env"),
        F.col("o_orderkey").alias("ord"),
        F.when((loc == 3) & (F.col("o_orderkey") % 97 == 0), F.lit(None).cast("double"))
         .otherwise(F.floor("o_totalprice").cast("double")).alias("w1"),
        (F.col("o_orderkey") % 31).cast("double").alias("w2"),
    )


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metadata row per Env with scattered NULLs; location L6 entirely NULL."""
    li = table(spark, sf_dir, "lineitem")
    # whole numbers are made distinct and written, so that no filter on the environment's name reaches the plots
    envs = li.select(_loc("l_suppkey").alias("loc"), (F.year("l_shipdate") + YEAR_SHIFT).alias("yr")).distinct()
    z = materialize(envs, "meta_envs").select(
        F.concat(F.lit("L"), F.col("loc").cast("string"), F.lit("_"), F.col("yr").cast("string")).alias("Env"),
        "loc", "yr")
    loc, yr = F.col("loc"), F.col("yr")
    dead = loc == 6

    def val(cond, expr):
        return F.when(cond | dead, F.lit(None).cast("double")).otherwise(expr.cast("double"))

    no = F.lit(False)
    return z.select(
        "Env",
        val((loc + yr) % 5 == 0, 40 + loc + yr % 3).alias("lat"),
        val((loc == 5) & (yr % 2 == 0), -90 - loc).alias("lon"),
        val(no, yr - 2000).alias("m3"),
        val(no, 2 * loc).alias("m4"),
        val(no, loc + yr).alias("m5"),
        val(no, loc * 7).alias("m6"),
        val(no, yr % 4).alias("m7"),
    )


def _dosage(e, i):
    return (F.when((F.col("vec_id") + i) % 17 == 0, F.lit(None).cast("double"))
             .when(e.cast("double") < -0.08, F.lit(0.0))
             .when(e.cast("double") > 0.08, F.lit(1.0))
             .otherwise(F.lit(0.5)))


def geno(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotype matrix in array form: (Hybrid, dosage array<double>) with values 0/0.5/1/NULL.

    One row per embedding vector (every vector is a genotyped hybrid).
    """
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        build_key(F.lit("H"), F.col("vec_id"), sep="").alias("Hybrid"),
        F.transform("embedding", _dosage).alias("dosage"),
    )


def test_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submission template: distinct (Env, Hybrid) of the unseen last year, empty yield.

    The year filter defines the test set (the year the models must predict),
    it is not a sample: every plot of that year contributes its key.
    """
    li = table(spark, sf_dir, "lineitem").filter(F.year("l_shipdate") == TEST_SHIP_YEAR)
    cells = li.select(_loc("l_suppkey").alias("loc"), (F.year("l_shipdate") + YEAR_SHIFT).alias("yr"),
                      (F.col("l_partkey") % N_HYBRIDS).alias("hybrid")).distinct()
    return cells.select(
        F.concat(F.lit("L"), F.col("loc").cast("string"), F.lit("_"), F.col("yr").cast("string")).alias("Env"),
        build_key(F.lit("H"), "hybrid", sep="").alias("Hybrid"),
    ).withColumn("Yield_Mg_ha", F.lit(None).cast("double"))


def component_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic per-(Env, Hybrid) predictions of three component models."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(
        F.concat(F.lit("L"), _loc("l_suppkey").cast("string"), F.lit("_"),
                 (F.year("l_shipdate") + YEAR_SHIFT).cast("string")).alias("Env"),
        build_key(F.lit("H"), F.col("l_partkey") % N_HYBRIDS, sep="").alias("Hybrid"),
    ).agg(
        F.sum("l_quantity").alias("y_add"),
        F.max("l_linenumber").cast("double").alias("y_dom"),
        F.count(F.lit(1)).cast("double").alias("y_env"),
    )


def variance_weights(spark: SparkSession) -> DataFrame:
    """Component variance table (component, V)."""
    return spark.createDataFrame(VARIANCE_WEIGHTS, "component string, V double")


# The fixture's sub-site codes and the environment they belong to.
FIXTURE_RECODE = {
    "L1_1_2019": "L1_2019",
    "L1_2_2019": "L1_2019",
    "L1_1_2021": "L1_2021",
    "L1_2_2021": "L1_2021",
}
