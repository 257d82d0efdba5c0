"""Blocked marker store, per-task marker vectors and relationship products.

A genotype matrix is cut into blocks of ``BLOCK`` markers: rows
(row, keys..., block, v) with one vector of a block's values.  No value
travels as a row of its own and no row holds all markers.

* Statistics (``block_stats``): every task adds its rows into one vector of
  counts and sums per block; the tasks' vectors are added per block.  Per
  marker that is one number a task, whatever the number of hybrids.
* Codings (``coded``): a block's rows meet that block's statistics, as
  vectors, and are mapped elementwise inside Spark.
* Relationship products (``relationship_product``): K x with K = Z Z' / c is
  computed as Z (Z' x) in two passes over the blocks, for several vectors x
  at once; K, hybrids by hybrids, is never formed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.operators.joins import join_by_size
from trialspark.session import materialize

# task functions travel with their job: executors need numpy and pyarrow, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4096
STATS = ("n", "total", "n0", "n1", "n2")  # non-missing, their sum, values equal to 0, 1, 2
_DOUBLES = "array<double>"


def _positions(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list array (NaN where NULL) and each value's place in its list."""
    sizes = arr.value_lengths().fill_null(0).to_numpy()
    values = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _added(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add the vectors of each block over all tasks, in the tasks' order: (block, names...)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(block, sums):
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), *[pa.array([s.tolist()], pa.list_(pa.float64())) for s in sums]],
                ["block", *names])

        now, held = None, None
        for batch in batches:  # sorted: a block's vectors follow each other
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("block", *names)]
            for r in range(batch.num_rows):
                block = cols[0][r].as_py()
                part = [c[r].values.to_numpy(zero_copy_only=False) for c in cols[1:]]
                if block != now and held is not None:
                    yield out(now, held)
                    held = None
                if held is None:
                    held = [p.copy() for p in part]
                else:
                    held = [_longest_sum(h, p) for h, p in zip(held, part)]
                now = block
        if held is not None:
            yield out(now, held)

    schema = "block int, " + ", ".join(f"{c} {_DOUBLES}" for c in names)
    return (rows.repartition("block").sortWithinPartitions("block", "task")
            .mapInArrow(add, schema))


def _longest_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) < len(b):
        a, b = b, a
    out = a.copy()
    out[:len(b)] += b
    return out


def block_stats(g: DataFrame, col: str = "dosage", size: int = BLOCK) -> DataFrame:
    """(block, n, total, n0, n1, n2): per-marker statistics of (.., array) rows as vectors of ``size`` markers.

    Arrays may differ in length; NULL arrays and values count for nothing.
    """
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list = []
        for batch in batches:
            v, at = _positions(batch.column(0))
            if not len(v):
                continue
            width = int(at.max()) + 1
            ok = ~np.isnan(v)
            flags = [ok.astype(float), np.where(ok, v, 0.0), *[(v == x).astype(float) for x in (0, 1, 2)]]
            part = [np.bincount(at, f, width) for f in flags]
            held = [_longest_sum(h, p) for h, p in zip(held, part)] if held else part
        task = TaskContext.get().partitionId()
        for b in range(-(-len(held[0]) // size) if held else 0):
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([task], pa.int32()),
                 *[pa.array([h[b * size:(b + 1) * size].tolist()], pa.list_(pa.float64())) for h in held]],
                ["block", "task", *STATS])

    schema = "block int, task int, " + ", ".join(f"{c} {_DOUBLES}" for c in STATS)
    return _added(g.select(F.col(f"`{col}`").cast(_DOUBLES).alias("_v")).mapInArrow(sums, schema), STATS)


def per_marker(stats: DataFrame, size: int = BLOCK, **columns) -> DataFrame:
    """One row per marker: i and each named column, a function of the marker's STATS struct."""
    rows = stats.select("block", F.posexplode(F.arrays_zip(*STATS)).alias("_p", "_s"))
    s = {c: F.col(f"_s.{c}") for c in STATS}
    return rows.select((F.col("block") * size + F.col("_p")).cast("int").alias("i"),
                       *[fn(s).alias(name) for name, fn in columns.items()])


def slices(rows: DataFrame, col: str = "dosage", size: int = BLOCK) -> DataFrame:
    """(other columns..., block, v): each array in slices; an empty or NULL array has none."""
    n = F.size(f"`{col}`")
    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))
    keys = [F.col(f"`{c}`") for c in rows.columns if c != col]
    cut = rows.select(*keys, F.col(f"`{col}`").cast(_DOUBLES).alias("_v"), F.explode(blocks).alias("block"))
    return cut.select(*keys, "block", F.slice("_v", F.col("block") * size + 1, size).alias("v"))


def numbered(g: DataFrame, row: str = "row") -> DataFrame:
    """``g`` with ``row``, a number per row.  Written, because the number has to stay the same."""
    return materialize(g.withColumn(row, F.monotonically_increasing_id()), "genotype_rows")


def from_blocks(store: DataFrame, row: str = "row", v: str = "v") -> DataFrame:
    """(row, v): the blocks of each row joined again, in order."""
    return store.groupBy(row).agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("block", v))), lambda s: s[v])).alias(v))


def coded(store: DataFrame, stats: DataFrame, stat: str, fn, v: str = "v", out: str = "v") -> DataFrame:
    """``out`` = fn(value, statistic) for every value of the blocks; ``stats`` is (block, ``stat`` vector).

    The statistics are written and broadcast by their size; beyond it the
    blocks meet them in a join whose skewed partitions can be split.
    """
    side = materialize(stats.select("block", F.col(stat).cast(_DOUBLES).alias("_stat")), "block_statistic")
    joined = join_by_size(store, side, "block", "left")
    return joined.select(*[c for c in store.columns if c != out], F.transform(
        v, lambda x, i: fn(x, F.get("_stat", i))).alias(out))


def stat_vector(stats: DataFrame, name: str, fn) -> DataFrame:
    """(block, ``name``): a vector per block, a function of each marker's STATS struct."""
    return stats.select("block", F.transform(F.arrays_zip(*STATS), lambda s: fn({c: s[c] for c in STATS})).alias(name))


def allele2(s: dict[str, Column]) -> Column:
    """Frequency of the allele coded 2; NULL where nothing is known."""
    return F.try_divide(s["n2"] * 2 + s["n1"], s["n"] * 2)


def allele0(s: dict[str, Column]) -> Column:
    return F.try_divide(s["n0"] * 2 + s["n1"], s["n"] * 2)


def relationship_product(store: DataFrame, vectors: DataFrame, k: int, divisor: float, row: str = "row") -> DataFrame:
    """(row, y): y = Z (Z' x) / divisor for ``k`` vectors x at once.

    ``store`` holds Z as (row, block, v), the same markers for every row and
    no NULLs, ``vectors`` (row, x array of k).  First pass: u = Z' x, one k-vector per marker, added per
    block.  Second pass: every block's rows take their part of Z u, added per
    row.  Rows without a block get no y.
    """
    z = store.select(row, "block", "v")

    def transposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            v, _ = _positions(batch.column(1))
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            sizes = batch.column(1).value_lengths().to_numpy()
            owner = np.repeat(blocks, sizes)
            for b in np.unique(blocks):
                rows = blocks == b
                part = (x[rows].T @ v[owner == b].reshape(int(rows.sum()), -1)).ravel()
                held[int(b)] = held[int(b)] + part if int(b) in held else part
        task = TaskContext.get().partitionId()
        for b in sorted(held):
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([task], pa.int32()), pa.array([held[b].tolist()], pa.list_(pa.float64()))],
                ["block", "task", "u"])

    met = join_by_size(z, materialize(vectors.select(row, "x"), "product_vectors"), row)
    partial = met.select("block", "v", "x").mapInArrow(transposed, f"block int, task int, u {_DOUBLES}")
    u = materialize(_added(partial, ["u"]), "product_markers")

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.empty((batch.num_rows, k))
            for r in range(batch.num_rows):
                v = batch.column(1)[r].values.to_numpy(zero_copy_only=False)
                w = batch.column(2)[r].values.to_numpy(zero_copy_only=False).reshape(k, -1)
                y[r] = w[:, :len(v)] @ v
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(y[:, j]) for j in range(k)]],
                                             [row, *[f"y{j}" for j in range(k)]])

    schema = f"{row} bigint, " + ", ".join(f"y{j} double" for j in range(k))
    parts = join_by_size(z, u, "block").select(row, "v", "u").mapInArrow(times, schema)
    sums = parts.groupBy(row).agg(*[F.sum(f"y{j}").alias(f"y{j}") for j in range(k)])
    return sums.select(row, F.array(*[F.col(f"y{j}") / F.lit(float(divisor)) for j in range(k)]).alias("y"))
