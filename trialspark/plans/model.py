"""Model search, fit and prediction.

The analysis searches boosted-tree parameters with fold-wise MSE and predicts
the test rows with the best model.  Here:

* the training rows become one binned matrix (``prepare_binned``), read by
  every candidate and fold; NULL scalars, NULL markers and hybrids without
  genotype stay missing and the splits learn their direction;
* ``search_binned`` scores candidates from the same ranges on explicit folds
  (leave-one-year-out or contiguous) with a resumable ledger
  (``plans.search``); every parameter of a candidate acts on the fit;
* the best candidate is refit once on all training rows and applied to the
  test rows.  The boosted recipes grow all splits to ``max_depth``, the
  leaf-wise one best gain first to ``num_leaves``.

Spark ML's ``GBTRegressor`` and ``RandomForestRegressor`` under a
``CrossValidator`` remain as a second way (``prepare``, ``search_and_fit``).
They have no leaf penalties, no leaf-count limit and no missing values, so
there scalars are filled with training means plus a 0/1 indicator, markers
with zero, and those parameters of a candidate have no effect.

Every fit is a set of distributed Spark jobs; the training matrix is written
to the shared checkpoint folder first so the many fits read it instead of
recomputing the feature pipeline.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.operators import binning as BI
from trialspark.operators import boosting as BO
from trialspark.plans import folds as FO
from trialspark.plans import matrices as MX
from trialspark.plans import search as SE
from trialspark.session import materialize, scratch_path

# Search spaces of the analysis, (low, high, prior); int bounds mean integer draws.
BOOSTED_SPACE = {
    "n_estimators": (2000, 7000, "log-uniform"),
    "learning_rate": (0.005, 0.3, "log-uniform"),
    "max_depth": (2, 15, "log-uniform"),
    "min_child_weight": (1, 20, "log-uniform"),
    "subsample": (0.1, 1, "uniform"),
    "colsample_bytree": (0.1, 1, "uniform"),
    "gamma": (0.01, 0.5, "log-uniform"),
    "reg_alpha": (10, 200, "log-uniform"),
    "reg_lambda": (1, 10, "log-uniform"),
}
ENV_ONLY_SPACE = dict(BOOSTED_SPACE, n_estimators=(100, 7000, "log-uniform"))
LEAF_WISE_SPACE = {
    "n_estimators": (2000, 7000, "log-uniform"),
    "learning_rate": (0.005, 0.3, "log-uniform"),
    "num_leaves": (10, 10000, "uniform"),
    "min_child_samples": (10, 200, "log-uniform"),
    "max_depth": (2, 15, "uniform"),
    "min_child_weight": (1, 20, "log-uniform"),
    "subsample": (0.1, 1, "uniform"),
    "colsample_bytree": (0.1, 1, "uniform"),
    "reg_alpha": (10, 200, "log-uniform"),
    "reg_lambda": (1, 10, "log-uniform"),
}
SEED = 99
N_ITER = 20          # genotype models
N_ITER_ENV = 100     # environment-only model
N_CONTIGUOUS_FOLDS = 5
# Spark tree depth limit
SPARK_MAX_DEPTH = 30


@dataclass
class Budget:
    """Number of candidates, of Spark ML fits at a time, and of candidates proposed together.

    A lighter search declares a lighter space, candidates are never cut afterwards.
    """

    n_iter: int = N_ITER
    parallelism: int = 2
    batch: int = 4


def sample_candidates(space: Mapping[str, tuple], n_iter: int, seed: int = SEED) -> list[dict]:
    """Seeded draws from the search space (log-uniform or uniform; ints rounded)."""
    rng = np.random.RandomState(seed)
    out = []
    for _ in range(n_iter):
        cand = {}
        for name, (lo, hi, prior) in space.items():
            if prior == "log-uniform":
                x = math.exp(rng.uniform(math.log(lo), math.log(hi)))
            else:
                x = rng.uniform(lo, hi)
            if isinstance(lo, int) and isinstance(hi, int):
                x = int(min(max(round(x), lo), hi))
            cand[name] = x
        out.append(cand)
    return out


def spark_params(est, cand: Mapping) -> dict:
    """The candidate's parameters that Spark ML has, unchanged; a depth Spark cannot grow is an error."""
    trees = int(cand.get("n_estimators", 100))
    depth = int(cand.get("max_depth", 5))
    if depth > SPARK_MAX_DEPTH:
        raise ValueError(f"max_depth {depth} is over Spark's limit of {SPARK_MAX_DEPTH}")
    min_inst = int(max(cand.get("min_child_weight", 1), cand.get("min_child_samples", 1)))
    colsample = float(cand.get("colsample_bytree", 1.0))
    p = {est.maxDepth: depth, est.minInstancesPerNode: min_inst,
         est.subsamplingRate: float(cand.get("subsample", 1.0)),
         est.featureSubsetStrategy: "all" if colsample >= 1.0 else f"{colsample:.6f}",
         est.minInfoGain: float(cand.get("gamma", 0.0))}
    if isinstance(est, GBTRegressor):
        p[est.maxIter] = trees
        p[est.stepSize] = float(cand.get("learning_rate", 0.1))
    else:
        p[est.numTrees] = trees
    return p


@dataclass
class PreparedData:
    train: DataFrame
    test: DataFrame | None
    feature_cols: list[str]
    fill: dict = field(default_factory=dict)


def prepare(train: DataFrame, test: DataFrame | None, train_keys: Sequence[str],
            test_keys: Sequence[str], marker_means: DataFrame | None = None) -> PreparedData:
    """Impute, add indicators, assemble ``features``; write the training matrix.

    Hybrids without genotype get the marker means (``marker_means``, one row
    per marker) where they are given, as for raw dosages, and zeros else, the
    centre of the additive and dominance codings.

    Actions: the joined training rows are written first, so the means (one
    value per feature), the marker count and the matrix read them instead of
    evaluating the joins again.
    """
    if marker_means is not None and "geno" in train.columns:
        train = MX.fill_missing_genotypes(train, marker_means)
        test = MX.fill_missing_genotypes(test, marker_means) if test is not None else None
    train = materialize(train, "train_rows")
    scalars = MX.feature_columns(train, train_keys)
    means = train.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in scalars]).first() \
        if scalars else None
    fill = {c: (means[c] if means and means[c] is not None else 0.0) for c in scalars}
    geno_len = None
    if "geno" in train.columns:
        row = train.select(F.max(F.size("geno")).alias("n")).first()
        geno_len = int(row["n"] or 0)
    tr = MX.ml_ready(train, scalars, fill, geno_len)
    inputs = scalars + [f"{c}__na" for c in scalars] + (["geno_vec"] if geno_len else [])
    assembler = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error")
    keep = list(dict.fromkeys([*train_keys, *[c for c in ["fold"] if c in tr.columns]]))
    tr = assembler.transform(tr).select(*keep, "features",
                                        F.col("Yield_Mg_ha").cast("double").alias("label"))
    tr = materialize(tr, "train_matrix")
    te = None
    if test is not None:
        aligned = MX.align_test(test, train.columns, test_keys, train_keys)
        te = assembler.transform(MX.ml_ready(aligned, scalars, fill, geno_len))
        te = te.select(*test_keys, "features")
    return PreparedData(tr, te, inputs, fill)


def make_estimator(kind: str = "boosted", seed: int = SEED):
    if kind == "boosted":
        return GBTRegressor(featuresCol="features", labelCol="label", seed=seed)
    if kind == "forest":
        return RandomForestRegressor(featuresCol="features", labelCol="label", seed=seed)
    raise ValueError(kind)


def search_and_fit(data: PreparedData, space: Mapping[str, tuple], kind: str = "boosted",
                   budget: Budget | None = None, seed: int = SEED):
    """Cross-validated search over sampled candidates; returns (best model, avg MSE per candidate).

    ``data.train`` must carry an integer ``fold`` column (0..k-1).
    """
    budget = budget or Budget()
    est = make_estimator(kind, seed)
    cands = sample_candidates(space, budget.n_iter, seed)
    grid = [spark_params(est, c) for c in cands]
    n_folds = data.train.agg(F.max("fold").alias("k")).first()["k"] + 1
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid,
                        evaluator=RegressionEvaluator(metricName="mse", labelCol="label"),
                        numFolds=max(int(n_folds), 2), foldCol="fold", seed=seed,
                        parallelism=budget.parallelism)
    model = cv.fit(data.train)
    return model.bestModel, list(model.avgMetrics)


def loyo(train: DataFrame) -> DataFrame:
    return FO.leave_one_group_out(train, "Year", "fold")


def contiguous(train: DataFrame, order: Sequence[str]) -> DataFrame:
    return FO.contiguous_folds(train, order, N_CONTIGUOUS_FOLDS, "fold")


def predict(model, test: DataFrame, keys: Sequence[str] = ("Env", "Hybrid")) -> DataFrame:
    """Submission table: Env, Hybrid, Yield_Mg_ha (predicted)."""
    return model.transform(test).select(*keys, F.col("prediction").alias("Yield_Mg_ha"))


@dataclass
class BinnedData:
    """Written blocks of the training rows, their bins and folds, and the test rows with the same features."""

    blocks: DataFrame
    bins: BI.Bins
    folds: list[int]
    test: DataFrame | None
    test_keys: list[str]


def prepare_binned(train: DataFrame, test: DataFrame | None, train_keys: Sequence[str],
                   test_keys: Sequence[str], bins: BI.Bins | None = None) -> BinnedData:
    """Bin the training rows (with an integer ``fold``); nothing missing is filled in.

    Actions: bin edges over all rows, then the blocks are written.  Hand in
    written rows: they are read three times.  ``bins`` of the same rows in
    other folds save looking for them again.
    """
    scalars = MX.feature_columns(train, train_keys)
    bins = bins or BI.find_bins(train, scalars, "geno" if "geno" in train.columns else None)
    blocks = BI.binned_blocks(train, bins, "Yield_Mg_ha", "fold")
    folds = sorted(r["fold"] for r in train.select("fold").distinct().collect())  # a handful
    aligned = None
    if test is not None:
        aligned = MX.align_test(test, [*scalars, *(["geno"] if "geno" in test.columns else [])], test_keys, [])
    return BinnedData(blocks, bins, folds, aligned, list(test_keys))


def search_binned(data: BinnedData, space: Mapping[str, tuple], budget: Budget | None = None, seed: int = SEED,
                  ledger: str | None = None) -> tuple[BO.Forest, SE.Ledger]:
    """Best model of a search over ``space`` and the search's ledger.

    ``ledger`` is a shared path that outlives the job (a restart goes on
    there); without one the ledger is a stage table of this run.
    """
    budget = budget or Budget()
    spark = data.blocks.sparkSession
    book = SE.Ledger(spark, ledger or scratch_path(spark, "search_ledger"))
    best, _ = SE.search(data.blocks, data.bins.n_bins, space, budget.n_iter, data.folds, book, budget.batch, seed)
    return SE.refit(data.blocks, data.bins.n_bins, best, seed), book


def predict_binned(model: BO.Forest, data: BinnedData, keys: Sequence[str] = ("Env", "Hybrid")) -> DataFrame:
    """Submission table: Env, Hybrid, Yield_Mg_ha (predicted); written, so that ensembles do not score again."""
    scored = BO.predict(data.test, model, data.bins, "_prediction")
    return materialize(scored.select(*keys, F.col("_prediction").alias("Yield_Mg_ha")), "predictions")
