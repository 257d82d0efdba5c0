"""Variance components by moments: additive, dominance and residual shares of a trait.

Model: y = mean + a + d + e with covariances V_a K_a + V_d K_d + V_e I, where
K_a = Z Z' / sum(2 p0 p2) and K_d = W W' / sum((2 p q)^2) are the additive and
dominance relationships.  With P the centring, the expected moments are

    y' P K_i P y = sum_j tr(P K_i P K_j) V_j        (i, j in a, d, e; K_e = I)

three equations in the three variances.  The traces are estimated with random
signs s: tr(P K_i P K_j) = E[(P K_i P s) . (P K_j P s)].  All products K x are
two passes over the marker blocks (``markers.relationship_product``) for y and
all sign vectors at once; no relationship matrix is formed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.operators import genotype as G
from trialspark.operators import markers as MK
from trialspark.operators.joins import join_by_size
from trialspark.session import materialize

COMPONENTS = ("additive", "dominance", "residual")
PROBES = 16


def sign(key: str, probe: int):
    """+1 or -1 from the key and the probe's number, the same in every run."""
    return F.when(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{probe}"))), 1, 1) < "8", 1.0).otherwise(-1.0)


def _mean_of(columns: Sequence, rows: DataFrame) -> list[float]:
    found = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [found[f"m{i}"] or 0.0 for i in range(len(columns))]


def moments(g_imputed: DataFrame, trait: DataFrame, probes: int = PROBES, col: str = "dosage", key: str = "Hybrid",
            value: str = "y") -> DataFrame:
    """The moment equations: (i, j, trace) for the component pairs i <= j and, with j NULL, the left sides.

    ``g_imputed`` is (key, marker array), every row with the same markers and
    any frequencies its own; ``trait`` (key, value) has one row per key.  Rows
    that lack either take no part.
    """
    stats = materialize(MK.block_stats(g_imputed, col), "marker_block_stats")
    p2 = MK.stat_vector(stats, "p2", MK.allele2)
    totals = MK.per_marker(stats, p0=MK.allele0, p2=MK.allele2).agg(
        F.sum(F.col("p0") * 2 * F.col("p2")).alias("a"),
        F.sum((F.col("p2") * 2 * (1 - F.col("p2"))) ** 2).alias("d")).first()
    rows = MK.numbered(join_by_size(
        g_imputed.filter(F.size(col) > 0).select(key, F.col(col).alias("_cells")),
        materialize(trait.filter(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_y")), "trait"),
        key))
    n = rows.count()
    xs = [F.col("_y"), *[sign(key, b) for b in range(1, probes + 1)]]
    means = _mean_of(xs, rows)
    vectors = materialize(rows.select("row", F.array(*[x - F.lit(m) for x, m in zip(xs, means)]).alias("x")), "probes")
    store = MK.slices(rows.select("row", "_cells"), "_cells")
    made = vectors
    for name, fn, divisor in (("additive", lambda x, p: F.coalesce(x - p * 2, F.lit(0.0)), totals["a"]),
                              ("dominance", lambda x, p: F.coalesce(G.dominance_value(x, p), F.lit(0.0)), totals["d"])):
        block = materialize(MK.coded(store, p2, "p2", fn), f"{name}_blocks")
        y = MK.relationship_product(block, vectors, probes + 1, divisor or 1.0)
        made = made.join(y.withColumnRenamed("y", name), "row")
    made = materialize(made.withColumnRenamed("x", "residual"), "moment_vectors")

    def dot(a, b):  # over the probes of a row
        return F.aggregate(F.zip_with(F.slice(a, 2, probes), F.slice(b, 2, probes), lambda p, q: p * q), F.lit(0.0),
                           lambda s, t: s + t)

    pairs = [(i, j) for k, i in enumerate(COMPONENTS) for j in COMPONENTS[k:]]
    sums = made.agg(*[F.sum(dot(F.col(i), F.col(j))).alias(f"{i}_{j}") for i, j in pairs],
                    *[F.sum(F.get("residual", F.lit(0)) * F.get(i, F.lit(0))).alias(f"y_{i}") for i in COMPONENTS],
                    *[F.sum(F.get(i, F.lit(b))).alias(f"s_{i}_{b}") for i in COMPONENTS for b in range(1, probes + 1)]).first()
    spark = g_imputed.sparkSession
    out = []
    for i, j in pairs:
        off = sum((sums[f"s_{i}_{b}"] or 0.0) * (sums[f"s_{j}_{b}"] or 0.0) for b in range(1, probes + 1)) / n if n else 0.0
        out.append((i, j, ((sums[f"{i}_{j}"] or 0.0) - off) / probes))
    out += [(i, None, sums[f"y_{i}"] or 0.0) for i in COMPONENTS]
    return spark.createDataFrame(out, "i string, j string, value double")


def solve(equations: Sequence[tuple]) -> dict[str, float]:
    """Variances from the (i, j or None, value) rows of ``moments``: least squares, negative estimates zero."""
    at = {c: k for k, c in enumerate(COMPONENTS)}
    t, q = np.zeros((3, 3)), np.zeros(3)
    for i, j, v in equations:
        if j is None:
            q[at[i]] = v
        else:
            t[at[i], at[j]] = t[at[j], at[i]] = v
    v = np.linalg.lstsq(t, q, rcond=None)[0]
    return {c: max(float(x), 0.0) for c, x in zip(COMPONENTS, v)}


def variance_components(g_imputed: DataFrame, trait: DataFrame, probes: int = PROBES, **kw) -> DataFrame:
    """(component, V) for the weighted ensembles; without any positive estimate all get the same."""
    v = solve([tuple(r) for r in moments(g_imputed, trait, probes, **kw).collect()])  # nine rows
    if not any(v.values()):
        v = dict.fromkeys(v, 1.0)
    return g_imputed.sparkSession.createDataFrame(list(v.items()), "component string, V double")
