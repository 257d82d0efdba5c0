"""Training-corpus pipeline: documents -> language ID -> near-dedup -> decontamination -> mixing -> shards.

Each stage takes (spark, docs, sf_dir), calls one operator of ``trialspark.llm``
on all rows its predecessor kept, and returns a DataFrame.  ``run`` writes
every stage's result as Parquet under ``spark.checkpoint.dir`` and reads it
back for the next one, so a lost executor costs at most a stage's tasks.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialspark.llm import decontaminate, language_id, ring_shards, simhash_dedup, soft_mixing
from trialspark.llm.common import table
from trialspark.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents without a letter, or whose language the calibrated model rejects, go."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group linked by 2 or fewer differing SimHash bits the smallest doc_id stays."""
    return simhash_dedup.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: every document is repeated as often as its fitted rate says."""
    return soft_mixing.mix(docs, table(spark, sf_dir, "labels"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the documents with their shard and slot."""
    return ring_shards.assign_shards(docs)


STAGES = [("language ID", identify_language), ("SimHash near-dedup", drop_near_duplicates),
          ("benchmark decontamination", drop_benchmark_leaks), ("mixing sources to target weights", mix_domains),
          ("sharding", shard)]

#: The first stage is a trained model and the second hashes with XXH64; neither can be said in DuckDB SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline_" + name.split()[0].lower())
    return docs
