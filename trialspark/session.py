"""Session construction and lineage cutting.

All tuning lives here so every pipeline runs with the same execution model:
adaptive query execution re-plans joins at runtime (a shuffle side whose
measured size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` is
broadcast, anything larger stays a sort-merge join) and splits skewed join
partitions, so no join in the library needs a blind ``broadcast()`` hint.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # runtime (measured) size under which AQE turns a shuffle join into a broadcast
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # local mode runs executors inside the driver JVM
    "spark.driver.memory": "8g",
}

# For tables whose records are of a megabyte or so: Parquet looks at sizes only every hundred records,
# so a page or a row group would hold a hundred of them, and readers and codecs as much outside the heap.
LARGE_RECORDS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
                 "parquet.block.size": str(16 << 20), "parquet.enable.dictionary": "false"}


def get_spark(master: str | None = None, app: str = "trialspark",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's execution settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder used to cut lineage.

    Reads ``spark.checkpoint.dir`` from the session (what a cluster sets to a
    shared file system).  Only a local-mode session without that setting gets
    a fresh private folder, as in tests; a cluster session without it is an
    error, because a machine-local folder is not visible to other executors.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        d = tempfile.mkdtemp(prefix="trialspark-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark)
    path = os.path.join(base, f"{name}-{os.urandom(6).hex()}")
    for written in _scopes[-1:]:
        written.append(path)
    return path


_scopes: list[list[str]] = []


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the stage tables written inside when the block ends.

    Whatever is to outlive the block has to be written elsewhere before it
    ends: frames built inside read the stage tables.  Scopes nest; a table
    belongs to the innermost one.  Yields the paths written so far.
    """
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def arrow_batches(spark: SparkSession, records: int) -> Iterator[None]:
    """Hand at most ``records`` records at a time (one at least) to the Python functions of the jobs run inside.

    Arrow batches are bounded by records alone, so large records need fewer; a lower setting of the session stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    bound = max(records, 1)
    spark.conf.set(key, str(bound if int(before) <= 0 else min(int(before), bound)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a frame that ``materialize`` returned; nothing may read it any more."""
    path = getattr(df, "_stage_path", None)
    if path:
        _delete(df.sparkSession, path)


def materialize(df: DataFrame, name: str = "stage", options: Mapping[str, str] | None = None) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back (an action).

    Cuts lineage at stage boundaries: later stages plan against a file scan
    (with real size statistics for AQE) instead of re-deriving the stage, a
    lost executor costs re-reading files rather than recomputing upstream
    stages, and iterative work (model search) reads the written table.
    ``options`` are the writer's, as ``LARGE_RECORDS``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").options(**(options or {})).parquet(path)
    written = spark.read.parquet(path)
    written._stage_path = path
    return written
