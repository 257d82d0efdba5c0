"""Global row order without a single-partition window.

``row_number().over(Window.orderBy(...))`` moves every row into one task.
Here rows are range-partitioned and sorted, tagged with (partition, position)
and written once to the shared checkpoint folder; the per-partition totals
(one row per partition) give each partition's starting offset.  Writing the
tagged rows makes the partition assignment a fact on disk, so the totals and
the rows can never disagree (two evaluations of a range shuffle may sample
different boundaries).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from trialspark.session import materialize

_LOW33 = (1 << 33) - 1


def _tagged(df: DataFrame, order: Sequence[str], num_partitions: int | None) -> DataFrame:
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an explicit partition count keeps AQE from coalescing the range partitions
    sorted_df = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()  # (partition id << 33) + position in partition
    tagged = sorted_df.withColumn("_rix_mid", mid)
    tagged = tagged.select("*", F.shiftright("_rix_mid", 33).alias("_rix_pid"),
                           F.col("_rix_mid").bitwiseAND(F.lit(_LOW33)).alias("_rix_pos")) \
                   .drop("_rix_mid")
    return materialize(tagged, "row_index")


def _offsets(totals: DataFrame, value: str) -> DataFrame:
    # one row per range partition: a running total over a tiny table
    w = Window.orderBy("_rix_pid").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_rix_pid", F.coalesce(F.sum(value).over(w), F.lit(0)).alias("_rix_off"))


def with_row_index(df: DataFrame, order: Sequence[str], name: str = "row_idx",
                   num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` (long): 0-based position of the row in ``order`` order.

    ``order`` should be unique per row for a deterministic result.  Action:
    the sorted rows are written once to the shared checkpoint folder.
    """
    tagged = _tagged(df, list(order), num_partitions)
    counts = tagged.groupBy("_rix_pid").agg(F.count(F.lit(1)).alias("_rix_cnt"))
    # offsets: one row per range partition (bounded by the partition count)
    return (tagged.join(F.broadcast(_offsets(counts, "_rix_cnt")), "_rix_pid")
            .withColumn(name, F.col("_rix_off") + F.col("_rix_pos"))
            .drop("_rix_pid", "_rix_pos", "_rix_off"))


def with_weighted_start(df: DataFrame, order: Sequence[str], weight: str, name: str = "start",
                        num_partitions: int | None = None) -> DataFrame:
    """Add ``name``: sum of ``weight`` over all rows before this one in ``order`` order.

    Used on (value, count) rows: row r then covers ranks [start, start + count).
    The within-partition running sum is a window per range partition, whose
    size is bounded by the range partitioning, never a global window.
    """
    tagged = _tagged(df, list(order), num_partitions)
    totals = tagged.groupBy("_rix_pid").agg(F.sum(weight).alias("_rix_w"))
    w = Window.partitionBy("_rix_pid").orderBy("_rix_pos") \
              .rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(weight).over(w), F.lit(0))
    return (tagged.withColumn("_rix_in", within)
            .join(F.broadcast(_offsets(totals, "_rix_w")), "_rix_pid")
            .withColumn(name, F.col("_rix_off") + F.col("_rix_in"))
            .drop("_rix_pid", "_rix_pos", "_rix_off", "_rix_in"))
