"""Marker-genotype operators on ``(Hybrid, array<double>)`` rows.

A genotype matrix is one row per hybrid with an array of marker values, not
one column per marker.  Per-marker statistics come from ``operators.markers``:
every task adds its rows into vectors, one row per block of markers leaves it,
and no cell becomes a row.  The statistics are written once and their markers
counted: up to ``MAX_BROADCAST_MARKERS`` they travel as one broadcast row (8
bytes a marker, whatever the number of hybrids), applied with
``transform(values, (x, i) -> f(x, stat[i]))`` inside codegen; beyond it the
arrays are cut into blocks of markers that meet the statistics of their block
and are joined again per input row.  Both forms keep every input row: a NULL
array stays NULL, an empty one empty, rows of a repeated hybrid stay apart.

Codings (values 0/1/2 = copies of the counted allele, p = its frequency):
  additive   z = x - 2p, missing -> 0
  dominance  missing -> 0 first; 0 -> -2p^2, 1 -> 2p(1-p), 2 -> -2(1-p)^2, else 0
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.operators import markers as MK
from trialspark.session import materialize


def scale_dosage(g: DataFrame, col: str = "dosage", factor: float = 2.0) -> DataFrame:
    """0/0.5/1 -> 0/1/2 (multiply every marker value)."""
    return g.withColumn(col, F.transform(col, lambda x: x * F.lit(factor)))


def explode_markers(g: DataFrame, col: str = "dosage", id_col: str = "Hybrid",
                    value: str = "v") -> DataFrame:
    """Long form (id, i, value): one row per cell, NULL cells kept."""
    return g.select(id_col, F.posexplode(col).alias("i", value))


def marker_means(g: DataFrame, col: str = "dosage") -> DataFrame:
    """Per-marker mean ignoring missing values: (i, mean); all-missing -> NULL."""
    return MK.per_marker(MK.block_stats(g, col), mean=lambda s: F.try_divide(s["total"], s["n"]))


def allele_freq(g: DataFrame, col: str = "dosage") -> DataFrame:
    """Per-marker frequencies of the allele coded 0 and the allele coded 2.

    p_y = (2 * #(x == y) + #(x == 1)) / (2 * #non-missing); all-missing -> NULL.
    Output (i, p0, p2).
    """
    return MK.per_marker(MK.block_stats(g, col), p0=MK.allele0, p2=MK.allele2)


def marker_vector(stats: DataFrame, value: str, name: str | None = None) -> DataFrame:
    """Gather per-marker rows (i, value) into one row: ``name`` array<double> indexed by i.

    The single row holds one double per marker (bounded by the marker count).
    """
    name = name or value
    return stats.agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("i"), F.col(value).cast("double").alias("v")))),
        lambda s: s["v"]).alias(name))


# Most markers gathered into one broadcast row (8 bytes each, tens of MB as gathered structs).
MAX_BROADCAST_MARKERS = 1_000_000


def apply_marker_stat(g: DataFrame, col: str, stats: DataFrame, stat: str, out: str, fn,
                      max_markers: int = MAX_BROADCAST_MARKERS) -> DataFrame:
    """out = transform(col, (x, i) -> fn(x, stat[i])) with per-marker ``stats`` (i, stat).

    The statistics (one row per marker) are written once to the checkpoint
    folder and counted: up to ``max_markers`` they travel as one broadcast
    row; beyond it the arrays are cut into blocks of markers, which meet the
    statistics of their block, and each row's array is joined again from its
    blocks.  Both ways give the same rows; a marker without a statistic has a
    NULL one.
    """
    st = materialize(stats.select("i", F.col(stat).cast("double").alias("_stat")), "marker_stats")
    keys = [c for c in g.columns if c != col]
    if st.count() <= max_markers:
        vec = marker_vector(st, "_stat", "_stat")
        res = g.crossJoin(F.broadcast(vec)).withColumn(
            out, F.transform(col, lambda x, i: fn(x, F.get("_stat", i))))
        return res.select(*keys, out)
    rows = MK.numbered(g, "_rid")
    store = MK.slices(rows.select("_rid", F.col(col).alias("_cells")), "_cells")
    coded = MK.from_blocks(MK.coded(store, stat_blocks(st), "_stat", fn), "_rid")
    return rows.join(coded, "_rid", "left").select(
        *keys, F.when(F.col(col).isNotNull(), F.coalesce("v", F.array().cast("array<double>"))).alias(out))


def stat_blocks(st: DataFrame, stat: str = "_stat") -> DataFrame:
    """(block, vector) from (i, statistic) rows: one row per ``markers.BLOCK`` markers, gaps NULL."""
    block = F.floor(F.col("i") / MK.BLOCK).cast("int")
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("i") % MK.BLOCK, F.col(stat))))
    return st.groupBy(block.alias("block")).agg(pairs.alias("_m"), F.max(F.col("i") % MK.BLOCK).alias("_last")).select(
        "block", F.transform(F.sequence(F.lit(0), "_last"), lambda p: F.try_element_at("_m", p)).alias(stat))


def impute_markers(g: DataFrame, col: str = "dosage",
                   max_markers: int = MAX_BROADCAST_MARKERS) -> DataFrame:
    """Fill missing values with the marker mean rounded half-to-even.

    Markers with no observed value stay missing.
    """
    means = marker_means(g, col).withColumn("mean", F.bround("mean", 0))
    return apply_marker_stat(g, col, means, "mean", col, lambda x, mu: F.coalesce(x, mu),
                             max_markers)


def additive_coding(g_imputed: DataFrame, col: str = "dosage", out: str = "z", freq: DataFrame | None = None,
                    max_markers: int = MAX_BROADCAST_MARKERS) -> DataFrame:
    """Additive (allele-centred) coding z = x - 2p, missing -> 0; p from the imputed matrix (or ``freq``)."""
    return apply_marker_stat(g_imputed, col, freq or allele_freq(g_imputed, col), "p2", out,
                             lambda x, p: F.coalesce(x - p * 2, F.lit(0.0)), max_markers)


def dominance_value(x, p):
    q = F.lit(1.0) - p
    x0 = F.coalesce(x, F.lit(0.0))
    return (F.when(x0 == 0, p * p * -2)
             .when(x0 == 1, p * q * 2)
             .when(x0 == 2, q * q * -2)
             .otherwise(F.lit(0.0)))


def dominance_coding(g_imputed: DataFrame, col: str = "dosage", out: str = "w", freq: DataFrame | None = None,
                     max_markers: int = MAX_BROADCAST_MARKERS) -> DataFrame:
    """Dominance-deviation coding (missing -> 0 first, then by genotype class)."""
    return apply_marker_stat(g_imputed, col, freq or allele_freq(g_imputed, col), "p2", out,
                             dominance_value, max_markers)


def marker_variance(g_imputed: DataFrame, col: str = "dosage") -> DataFrame:
    """Per-marker 2p(1-p) from the allele-2 frequency: (i, p0, p2, two_pq)."""
    f = allele_freq(g_imputed, col)
    return f.withColumn("two_pq", F.col("p2") * (F.lit(1.0) - F.col("p2")) * 2)


def total_two_pq(g_imputed: DataFrame, col: str = "dosage") -> DataFrame:
    """Sum over markers of 2 * p0 * p2 (one row: two_pq_sum)."""
    f = allele_freq(g_imputed, col)
    return f.agg(F.sum(F.col("p0") * 2 * F.col("p2")).alias("two_pq_sum"))
