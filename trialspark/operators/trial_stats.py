"""Fixed-effect trial statistics: residual outlier flags and per-site BLUEs.

Both operators fit ordinary least squares ``y ~ cell + factor`` inside a
*batch* (a year batch for outliers, a site for BLUEs), where ``cell`` is a
large factor (hybrid-by-environment, or hybrid) and ``factor`` a small one
(replicate).  The large factor is absorbed (Frisch-Waugh-Lovell): only the
``k`` replicate contrasts are solved for, from moments that are built out of
per-(batch, cell, level) sufficient statistics:

* ``level_stats``  groupBy(batch, cell, level) -> n, mean y, centred sum of squares
  (map-side partial aggregation, so a hot cell is pre-aggregated before the
  shuffle and never lands in one task as raw rows);
* ``cells``        groupBy(batch, cell) over those rows, with the <= k+1
  level statistics of the cell kept as a small array;
* moments          S = sum_c (diag(n_cl) - n_c n_c' / n_c), b = sum_c n_cl (ybar_cl -
  ybar_c), T = sum_c sum_l (css_cl + n_cl (ybar_cl - ybar_c)^2), aggregated per batch.
  Only centred sums occur, so a large common offset costs no digits;
* solve            k = 1 in closed form on the JVM; k > 1 with one small
  ``applyInPandas`` over the per-batch moment rows (a few rows per batch);
* back-substitution  alpha_c = ybar_c - sum_l beta_l n_cl / n_c (the cell
  effect at the reference level, i.e. the BLUE), residual = y - alpha_c -
  beta_level, RSS = T - beta'b.

Columns aliased by the cells (rank deficiency) get beta = 0, as a pivoting QR
with tolerance 1e-7 would alias them.  The reference level is the smallest
level present in the batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.operators.joins import join_by_size, join_written
from trialspark.session import materialize

# Fixed value: relative tolerance of the pivoting QR used to detect aliased columns.
QR_TOL = 1e-7


@dataclass
class FixedEffectFit:
    """Result of :func:`fit_cell_factor_model`.

    cells:      batch keys, cell keys, ``_n`` (rows), ``_alpha`` (cell effect at the
                reference level), ``_bmap`` (level -> beta), ``_sd`` (residual sd of
                the batch), ``_nlev`` (distinct levels in the batch); the written
                cell table joined with the written per-batch table
    batches:    written per-batch table: batch keys, ``_T``, ``_N``, ``_nlev``,
                ``_bmap``, ``_rss``, ``_sd``
    table:      the written table that ``cells`` reads, for its size
    """

    cells: DataFrame
    batches: DataFrame
    table: DataFrame


def _solve_schema(batch_fields: list[T.StructField]) -> T.StructType:
    return T.StructType(batch_fields + [T.StructField("_l", T.LongType()),
                                        T.StructField("_beta", T.DoubleType()),
                                        T.StructField("_b", T.DoubleType())])


def _make_solver(batch: list[str]):
    """Per-batch solve of the k x k normal equations (k = levels - 1).

    Input rows are the batch's moment rows (kind, l, m, v).  Contrasts are
    taken in level order; a contrast whose residual sum of squares, after
    the cells and the earlier kept contrasts, falls below tol^2 * n_l is
    aliased and gets beta = 0.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = sorted(set(pdf.loc[pdf["_k"] == "n", "_l"]))
        contrasts = levels[1:]
        pos = {lv: i for i, lv in enumerate(contrasts)}
        k = len(contrasts)
        S = np.zeros((k, k))
        b = np.zeros(k)
        N = np.zeros(k)
        for kind, l, m, v in zip(pdf["_k"], pdf["_l"], pdf["_m"], pdf["_v"]):
            if l not in pos:
                continue
            if kind == "b":
                b[pos[l]] = v
            elif kind == "n":
                N[pos[l]] = v
                S[pos[l], pos[l]] += v
            elif kind == "P" and m in pos:
                S[pos[l], pos[m]] -= v
        kept: list[int] = []
        for j in range(k):
            r = S[j, j]
            if kept:
                r = r - S[j, kept] @ np.linalg.solve(S[np.ix_(kept, kept)], S[kept, j])
            if r > 0 and r >= (QR_TOL ** 2) * N[j]:
                kept.append(j)
        beta = np.zeros(k)
        if kept:
            beta[kept] = np.linalg.solve(S[np.ix_(kept, kept)], b[kept])
        out = pd.DataFrame({"_l": np.array(contrasts, dtype="int64"), "_beta": beta, "_b": b})
        for i, c in enumerate(batch):
            out.insert(i, c, pdf[c].iloc[0])
        return out

    return solve


def _level_moments(cells: DataFrame, batch: list[str]) -> DataFrame:
    """Moments of each (batch, level): _t = centred sum of squares, _nl = n_l, _b = sum n_l (ybar_l - ybar), _p = sum n_l^2 / n.

    One row per cell and level of it goes into the sums.
    """
    x = {c: F.col(f"_s.{c}") for c in ("_lv", "_n", "_m", "_css")}
    off = x["_m"] - F.col("_mean")
    return (cells.select(*batch, "_n", "_mean", F.explode("_levels").alias("_s"))
            .groupBy(*batch, x["_lv"].alias("_l"))
            .agg(F.sum(x["_css"] + x["_n"] * off * off).alias("_t"), F.sum(x["_n"].cast("double")).alias("_nl"),
                 F.sum(x["_n"] * off).alias("_b"), F.sum(x["_n"] * x["_n"] / F.col("_n").cast("double")).alias("_p")))


def _pair_moments(cells: DataFrame, batch: list[str]) -> DataFrame:
    """P_lm = sum n_l n_m / n of each (batch, level, level), in the solver's form (kind, l, m, v)."""
    pairs = F.flatten(F.transform("_levels", lambda a: F.transform("_levels", lambda b: F.struct(
        a["_lv"].alias("l"), b["_lv"].alias("m"), (a["_n"] * b["_n"] / F.col("_n").cast("double")).alias("v")))))
    return (cells.select(*batch, F.explode(pairs).alias("_c"))
            .groupBy(*batch, F.col("_c.l").alias("_l"), F.col("_c.m").alias("_m")).agg(F.sum("_c.v").alias("_v"))
            .select(*batch, F.lit("P").alias("_k"), "_l", "_m", "_v"))


def fit_cell_factor_model(df: DataFrame, trait: str, cell: Sequence[str], factor: str,
                          batch: Sequence[str]) -> FixedEffectFit:
    """Fit ``trait ~ cell + factor`` per batch without materialising dummies.

    Rows with NULL trait or NULL factor are excluded; ``factor`` must be integral.

    This is a fit step with actions: the per-cell statistics (one pass over
    ``df``), the per-batch solution (tiny) are
    written to the shared checkpoint folder, so the returned frames plan
    against file scans whose real sizes drive AQE's join choice (the
    per-batch table has one row per batch and is broadcast when small).
    """
    batch, cell = list(batch), list(cell)
    keys = batch + cell
    y = F.col(trait)
    rows = df.filter(y.isNotNull() & F.col(factor).isNotNull())

    level_stats = (rows.groupBy(*keys, F.col(factor).cast("long").alias("_lv"))
                   .agg(F.count(F.lit(1)).alias("_n"), F.avg(y).alias("_m"),
                        (F.var_pop(y) * F.count(F.lit(1))).alias("_css")))
    # the cell mean is taken around the cell's first level mean, which loses no digits
    first = F.col("_levels")[0]["_m"]
    off = F.aggregate("_levels", F.lit(0.0), lambda acc, x: acc + x["_n"] * (x["_m"] - first))
    cells = materialize(
        level_stats.groupBy(*keys)
        .agg(F.sum("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_lv", "_n", "_m", "_css"))).alias("_levels"))
        .withColumn("_mean", first + off / F.col("_n")),
        "fe_cells")

    levels = materialize(_level_moments(cells, batch), "fe_levels")
    # one row per batch: sums and the levels in order (as few as there are levels)
    at = F.col("_at")
    per_batch = levels.groupBy(*batch).agg(
        F.sum("_t").alias("_T"), F.sum("_nl").cast("long").alias("_N"),
        F.array_sort(F.collect_list(F.struct("_l", "_nl", "_b", "_p"))).alias("_at")).withColumn("_nlev", F.size("_at"))

    # k <= 1: closed form on the JVM (aliased when the contrast has no within-cell variance)
    l1 = F.col("_l1")
    k1 = per_batch.filter(F.col("_nlev") <= 2).select(*batch, "_T", "_N", "_nlev", F.get(at, F.lit(1)).alias("_s")).select(
        *batch, "_T", "_N", "_nlev", F.col("_s._l").alias("_l1"), F.col("_s._nl").alias("_n1"), F.col("_s._b").alias("_b1"),
        (F.col("_s._nl") - F.col("_s._p")).alias("_s1"))
    s1, n1, b1 = F.col("_s1"), F.col("_n1"), F.col("_b1")
    k1 = k1.withColumn("_beta1", F.when((s1 > 0) & (s1 >= F.lit(QR_TOL ** 2) * n1), b1 / s1)
                       .otherwise(F.lit(0.0)))
    two = F.col("_nlev") == 2
    small = k1.select(
        *batch, "_T", "_N", "_nlev",
        F.when(two, F.create_map(l1, F.col("_beta1")))
         .otherwise(F.create_map().cast("map<bigint,double>")).alias("_bmap"),
        F.when(two, F.col("_beta1") * b1).otherwise(F.lit(0.0)).alias("_fit_ss"))

    # k > 1: per-batch solve in pandas over that batch's moment rows (a few rows per batch)
    big = per_batch.filter(F.col("_nlev") > 2).select(*batch, "_T", "_N", "_nlev")
    solutions = small
    if not big.isEmpty():
        none = F.lit(None).cast("long")
        linear = levels.select(*batch, F.explode(F.array(*[
            F.struct(F.lit(kind).alias("_k"), "_l", none.alias("_m"), F.col(v).alias("_v"))
            for kind, v in (("b", "_b"), ("n", "_nl"))])).alias("_c")).select(*batch, "_c.*")
        ours = materialize(big.select(*batch), "fe_big_batches")
        moments = join_by_size(linear, ours, batch, "left_semi").unionByName(
            _pair_moments(join_by_size(cells, ours, batch, "left_semi"), batch))
        batch_fields = [df.schema[c] for c in batch]
        betak = moments.groupBy(*batch).applyInPandas(_make_solver(batch), _solve_schema(batch_fields))
        solved = (betak.groupBy(*batch).agg(
            F.map_from_entries(F.collect_list(F.struct("_l", "_beta"))).alias("_bmap"),
            F.sum(F.col("_beta") * F.col("_b")).alias("_fit_ss")))
        solutions = small.unionByName(big.join(solved, batch, "left").select(
            *batch, "_T", "_N", "_nlev",
            F.coalesce("_bmap", F.create_map().cast("map<bigint,double>")).alias("_bmap"),
            F.coalesce("_fit_ss", F.lit(0.0)).alias("_fit_ss")))

    batches = materialize(
        solutions
        .withColumn("_rss", F.greatest(F.col("_T") - F.col("_fit_ss"), F.lit(0.0)))
        .withColumn("_sd", F.when(F.col("_N") > 1, F.sqrt(F.col("_rss") / (F.col("_N") - 1))))
        .drop("_fit_ss"),
        "fe_batches")

    nc = F.col("_n").cast("double")
    bmap = F.col("_bmap")
    shift = F.aggregate("_levels", F.lit(0.0), lambda acc, x: acc + F.coalesce(
        F.element_at(bmap, x["_lv"]), F.lit(0.0)) * x["_n"])
    # one row per batch, written above: broadcast after the size check
    cells_out = (join_by_size(cells, batches.select(*batch, "_bmap", "_sd", "_nlev"), batch)
                 .select(*keys, "_n", (F.col("_mean") - shift / nc).alias("_alpha"),
                         "_bmap", "_sd", "_nlev"))
    return FixedEffectFit(cells=cells_out, batches=batches, table=cells)


def outlier_flag(df: DataFrame, trait: str = "Yield_Mg_ha", cell: Sequence[str] = ("Hybrid_Env",),
                 factor: str = "Replicate", batch: Sequence[str] = ("Year",),
                 k_sd: float = 2.0) -> DataFrame:
    """Residual outlier flag (adds ``RESID`` double and ``out_flag`` int 0/1).

    Residuals of ``trait ~ cell + factor`` fitted per batch; ``out_flag = 1``
    iff ``|RESID| > k_sd * sd(RESID)`` (sample sd, strict).  Rows with a
    missing trait or factor are dropped, as the fit cannot use them.
    """
    batch, cell = list(batch), list(cell)
    fit = fit_cell_factor_model(df, trait, cell, factor, batch)
    rows = df.filter(F.col(trait).isNotNull() & F.col(factor).isNotNull())
    # rows x cells: broadcast only when the written cells are small; beyond it a cell brings its effect alone
    out = join_by_size(rows, fit.cells.select(*batch, *cell, "_alpha"), batch + cell, measured=fit.table)
    out = join_by_size(out, fit.batches.select(*batch, "_bmap", "_sd"), batch)
    resid = (F.col(trait) - F.col("_alpha")
             - F.coalesce(F.element_at("_bmap", F.col(factor).cast("long")), F.lit(0.0)))
    out = out.withColumn("RESID", resid)
    flag = F.when(F.col("_sd").isNotNull() & (F.abs("RESID") > F.lit(k_sd) * F.col("_sd")), 1) \
            .otherwise(0)
    return out.select(*df.columns, "RESID", flag.cast("int").alias("out_flag"))


def residual_sd(df: DataFrame, trait: str = "Yield_Mg_ha", cell: Sequence[str] = ("Hybrid_Env",),
                factor: str = "Replicate", batch: Sequence[str] = ("Year",)) -> DataFrame:
    """Sample standard deviation of the fixed-effect residuals per batch: (batch..., resid_sd, n)."""
    batch = list(batch)
    fit = fit_cell_factor_model(df, trait, cell, factor, batch)
    return fit.batches.select(*batch, F.col("_sd").alias("resid_sd"), F.col("_N").alias("n"))


def outlier_filter(flagged: DataFrame) -> DataFrame:
    """Keep rows with ``out_flag = 0``."""
    return flagged.filter(F.col("out_flag") == 0)


def site_levels(df: DataFrame, site: Sequence[str], factor: str, trait: str) -> DataFrame:
    """Distinct non-null factor levels per site, over rows with a trait value."""
    return (df.filter(F.col(trait).isNotNull() & F.col(factor).isNotNull())
            .groupBy(*site).agg(F.count_distinct(factor).alias("n_rep")))


def blue_replicated(df: DataFrame, trait: str = "Yield_Mg_ha",
                    site: Sequence[str] = ("Year", "Field_Location"),
                    hybrid: str = "Hybrid", factor: str = "Replicate",
                    env_sep: str = "_") -> DataFrame:
    """BLUE of each hybrid at each site with >= 2 replicates.

    Fit ``trait ~ 0 + hybrid + factor`` per site and keep the hybrid
    coefficients (the hybrid effect at the lowest replicate level).
    Output: Year, Field_Location, Hybrid, <trait>, Env.
    """
    site = list(site)
    fit = fit_cell_factor_model(df, trait, [hybrid], factor, site)
    year, loc = site[0], site[1]
    return (fit.cells.filter(F.col("_nlev") >= 2)
            .select(year, loc, hybrid, F.col("_alpha").alias(trait),
                    F.concat(F.col(loc).cast("string"), F.lit(env_sep),
                             F.col(year).cast("string")).alias("Env")))


def blues_and_single_rep(df: DataFrame, trait: str = "Yield_Mg_ha",
                         site: Sequence[str] = ("Year", "Field_Location"),
                         hybrid: str = "Hybrid", factor: str = "Replicate",
                         env_sep: str = "_") -> tuple[DataFrame, DataFrame]:
    """(BLUEs of replicated sites, plot rows of single-replicate sites) from one fit.

    The fit's per-site table already holds each site's level count, so the
    other sites come from it instead of a second pass over ``df``.  Sites
    without any replicate number pass through like those with one.
    """
    site = list(site)
    fit = fit_cell_factor_model(df, trait, [hybrid], factor, site)
    year, loc = site[0], site[1]
    blues = (fit.cells.filter(F.col("_nlev") >= 2)
             .select(year, loc, hybrid, F.col("_alpha").alias(trait),
                     F.concat(F.col(loc).cast("string"), F.lit(env_sep),
                              F.col(year).cast("string")).alias("Env")))
    many = fit.batches.filter(F.col("_nlev") >= 2).select(*site)  # a written table
    single = (join_by_size(df.filter(F.col(trait).isNotNull()), many, site, "left_anti", measured=fit.batches)
              .select("Year", "Field_Location", "Hybrid", trait, "Env"))
    return blues, single


def blue_single_rep(df: DataFrame, trait: str = "Yield_Mg_ha",
                    site: Sequence[str] = ("Year", "Field_Location"),
                    factor: str = "Replicate") -> DataFrame:
    """Plot rows of sites with one replicate level or none, passed through unchanged.

    Output: Year, Field_Location, Hybrid, <trait>, Env.
    """
    site = list(site)
    many = site_levels(df, site, factor, trait).filter(F.col("n_rep") >= 2).select(*site)
    return (join_written(df.filter(F.col(trait).isNotNull()), many, site, "left_anti", "replicated_sites")
            .select("Year", "Field_Location", "Hybrid", trait, "Env"))
