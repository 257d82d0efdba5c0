"""Size-checked joins.

``join_by_size`` broadcasts the small side only after checking its size:
the optimizer's size statistic of that side (for a table written to the
checkpoint folder this is the real file size) must be under a bound.
Beyond the bound the join is pinned to a sort-merge join, so neither side
is broadcast on a guess and AQE can still split skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.session import materialize

# Broadcast bound for a side measured on disk (parquet; in memory it is a few times larger).
MAX_BROADCAST_BYTES = 32 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer size statistic of ``df`` (no job runs)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_written(big: DataFrame, small: DataFrame, on: str | Sequence[str], how: str = "left",
                 name: str = "side") -> DataFrame:
    """Write the reduced ``small`` side, then join by its measured size.

    The rows of ``big`` are not shuffled while the written side is under the
    bound, also where the static planner cannot know how small it is.
    """
    return join_by_size(big, materialize(small, name), on, how)


def join_by_size(big: DataFrame, small: DataFrame, on: str | Sequence[str], how: str = "inner",
                 max_bytes: int = MAX_BROADCAST_BYTES, measured: DataFrame | None = None) -> DataFrame:
    """Join ``big`` with ``small``; broadcast ``small`` only if its measured size is under ``max_bytes``.

    ``measured`` is the written table whose size bounds ``small`` when
    ``small`` is derived from it row for row (e.g. a many-to-one join onto it).
    """
    if estimated_bytes(measured if measured is not None else small) <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)
