"""Binned feature matrix: bin edges found once, rows stored as byte bins.

A learner that looks for splits among bins needs every feature value only as
a small code.  The edges come from mergeable per-feature summaries: each task
reduces its rows to (value, count) lists, the lists of a feature are shuffled
to one place and merged, and the merged list is cut into at most ``MAX_BINS``
bins.  A feature with no more than ``SUMMARY`` distinct values is summarised
exactly; beyond that a list is thinned to evenly spaced ranks, which moves an
edge by at most 2 / SUMMARY of the rows for each merge.

The binned rows are written as blocks of rows (feature-major bytes), so a pass
over the data moves a few large values instead of one wide row per plot, and
every candidate and fold reads the same table.  A NULL has a code of its own;
nothing is filled in.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.session import LARGE_RECORDS, arrow_batches, materialize

# task functions travel with their job: executors need numpy and pyarrow, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BINS = 254         # codes 0..253 are values
MISSING = 255          # code of a NULL or NaN
SUMMARY = 4096         # (value, count) pairs a feature's summary may hold
BLOCK_BYTES = 4 << 20  # bins of one block of rows
BATCH_BYTES = 64 << 20  # values or summaries handed to a task's Python at a time
MATRIX_BYTES = 16 << 20  # values of neighbouring batches that are summarised together
MAX_BLOCK_ROWS = 8192


@dataclass
class Bins:
    """Features, their inner edges and the number of array elements behind ``array_col``.

    ``cuts[f]`` are ascending; code k holds the values over ``cuts[f][k-1]`` up to ``cuts[f][k]``.
    The driver holds at most ``MAX_BINS`` doubles a feature.
    """

    scalars: list[str]
    array_col: str | None
    array_len: int
    cuts: list[np.ndarray]

    @property
    def names(self) -> list[str]:
        return [*self.scalars, *(f"{self.array_col}[{i}]" for i in range(self.array_len))]

    @property
    def n_bins(self) -> np.ndarray:
        return np.array([len(c) + 1 for c in self.cuts], np.int64)


def columns_of(df: DataFrame, scalars: Sequence[str], array_col: str | None) -> list:
    """The feature columns as doubles, the array last."""
    out = [F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(scalars)]
    return out + ([F.col(f"`{array_col}`").cast("array<double>").alias("_arr")] if array_col else [])


def to_matrix(columns: Sequence[pa.Array], n_scalars: int, array_len: int) -> np.ndarray:
    """Feature-major doubles (features x rows), NaN where the value is NULL or the array is."""
    n = len(columns[0]) if columns else 0
    out = np.full((n_scalars + array_len, n), np.nan)
    for i in range(n_scalars):
        out[i] = columns[i].to_numpy(zero_copy_only=False)
    if array_len:
        arr = columns[n_scalars]
        sizes = arr.value_lengths().fill_null(0).to_numpy()
        if ((sizes != 0) & (sizes != array_len)).any():
            raise ValueError(f"arrays of {np.unique(sizes)} elements in a matrix of {array_len}")
        values = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out[n_scalars:, sizes > 0] = values.reshape(-1, array_len).T
    return out


def _wide_matrices(batches: Iterator[pa.RecordBatch], n_scalars: int, array_len: int) -> Iterator[np.ndarray]:
    """The batches' matrices (``to_matrix``), small ones side by side up to ``MATRIX_BYTES``: each is sorted by feature."""
    held, size = [], 0
    for batch in batches:
        x = to_matrix(batch.columns, n_scalars, array_len)
        if held and size + x.nbytes > MATRIX_BYTES:
            yield np.concatenate(held, axis=1)
            held, size = [], 0
        held.append(x)
        size += x.nbytes
    if held:
        yield np.concatenate(held, axis=1)


def _thin(values: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``size`` of the pairs, evenly spaced by rank; each takes the counts up to the next."""
    if len(values) <= size:
        return values, counts
    ends = np.cumsum(counts)
    at = np.unique(np.searchsorted(ends, np.linspace(0, ends[-1] - 1, size // 2), side="right"))
    at[-1] = len(values) - 1
    upto = ends[at]
    return values[at], np.diff(np.concatenate(([0], upto)))


def merge_summaries(parts: Sequence[tuple[np.ndarray, np.ndarray]], size: int = SUMMARY) -> tuple[np.ndarray, np.ndarray]:
    """One (values, counts) list from several."""
    values, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.zeros(len(values), np.int64)
    np.add.at(counts, at, np.concatenate([p[1] for p in parts]))
    return _thin(values, counts, size)


def cuts_of(values: np.ndarray, counts: np.ndarray, max_bins: int = MAX_BINS) -> np.ndarray:
    """Inner edges: halfway between neighbouring values, all of them or those nearest to even ranks."""
    if len(values) < 2:
        return np.empty(0)
    middle = values[:-1] + (values[1:] - values[:-1]) / 2
    if len(values) <= max_bins:
        return middle
    ends = np.cumsum(counts)
    wanted = ends[-1] * np.arange(1, max_bins) / max_bins
    at = np.unique(np.minimum(np.searchsorted(ends, wanted), len(values) - 2))
    return middle[at]


def find_bins(df: DataFrame, scalars: Sequence[str], array_col: str | None = None, max_bins: int = MAX_BINS,
              summary: int = SUMMARY) -> Bins:
    """Bin edges of every feature over all rows (two jobs: array length, summaries)."""
    if not 2 <= max_bins <= MAX_BINS:
        raise ValueError(f"max_bins must be from 2 to {MAX_BINS}")
    array_len = int(df.agg(F.max(F.size(f"`{array_col}`"))).first()[0] or 0) if array_col else 0
    array_len = max(array_len, 0)
    n_scalars = len(scalars)
    n_features = n_scalars + array_len

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [None] * n_features
        for x in _wide_matrices(batches, n_scalars, array_len):
            for f in range(n_features):
                v = x[f][~np.isnan(x[f])]
                if len(v):
                    part = np.unique(v, return_counts=True)
                    held[f] = merge_summaries([held[f], part], summary) if held[f] else _thin(*part, summary)
        full = [f for f in range(n_features) if held[f]]
        for i in range(0, len(full), 64):
            some = full[i:i + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([held[f][0].tolist() for f in some], pa.list_(pa.float64())),
                 pa.array([held[f][1].tolist() for f in some], pa.list_(pa.int64()))], ["feature", "v", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(feature, part):
            return pa.RecordBatch.from_arrays(
                [pa.array([feature], pa.int32()),
                 pa.array([cuts_of(*part, max_bins).tolist()], pa.list_(pa.float64()))], ["feature", "cuts"])

        now, held = None, None  # sorted: a feature's parts follow each other
        for batch in batches:
            for f, v, n in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.array(v), np.array(n, np.int64)
                if f != now and held is not None:
                    yield edges(now, held)
                    held = None
                held = merge_summaries([held, part], summary) if held is not None else part
                now = f
        if held is not None:
            yield edges(now, held)

    found = (df.select(*columns_of(df, scalars, array_col))
             .mapInArrow(summarise, "feature int, v array<double>, n array<bigint>"))
    with arrow_batches(df.sparkSession, BATCH_BYTES // max(8 * n_features, 16 * summary)):
        rows = (found.repartition("feature").sortWithinPartitions("feature", F.size("v"), F.xxhash64("v", "n"))
                .mapInArrow(merge, "feature int, cuts array<double>").collect())
    cuts = [np.empty(0)] * n_features
    for r in rows:
        cuts[r["feature"]] = np.array(r["cuts"])
    return Bins(list(scalars), array_col if array_len else None, array_len, cuts)


def code_rows(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Byte codes (features x rows) of a matrix of values."""
    out = np.empty(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[f] = np.searchsorted(c, x[f])  # values over k cuts have code k
        out[f][np.isnan(x[f])] = MISSING
    return out


def block_rows(n_features: int) -> int:
    """Rows of a block."""
    return int(min(max(BLOCK_BYTES // max(n_features, 1), 16), MAX_BLOCK_ROWS))


def binned_blocks(df: DataFrame, bins: Bins, label: str, fold: str | None = None) -> DataFrame:
    """Write ``df`` as blocks (block, n, label, fold, bins): packed doubles, 16-bit folds, feature-major codes.

    Rows without a label are left out.  Without ``fold`` every row is in fold 0.
    """
    n_scalars, array_len, cuts = len(bins.scalars), bins.array_len, bins.cuts
    size = block_rows(len(cuts))
    cols = columns_of(df, bins.scalars, bins.array_col)
    rows = df.select(*cols, F.col(f"`{label}`").cast("double").alias("_y"),
                     (F.col(f"`{fold}`").cast("int") if fold else F.lit(0)).alias("_fold")).filter("_y is not null")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33  # fixed with the written blocks
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                codes = code_rows(to_matrix(part.columns[:-2], n_scalars, array_len), cuts)
                y = part.column(part.num_columns - 2).to_numpy(zero_copy_only=False).astype("<f8")
                k = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype("<i2")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([part.num_rows]), pa.array([y.tobytes()]), pa.array([k.tobytes()]),
                     pa.array([codes.tobytes()])], ["block", "n", "label", "fold", "bins"])
                block += 1

    with arrow_batches(df.sparkSession, BATCH_BYTES // max(8 * len(cuts), 1)):
        return materialize(rows.mapInArrow(pack, "block bigint, n bigint, label binary, fold binary, bins binary"),
                           "binned_rows", LARGE_RECORDS)
