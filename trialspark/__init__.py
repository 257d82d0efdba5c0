"""trialspark: multi-environment field-trial analytics on Spark DataFrames.

Sub-packages
------------
sources    readers and writers (delimited text, genotype text, VCF lines, sinks)
           and the views that map the benchmark tables onto trial tables
functions  column expressions (keys, recodes, half-even rounding, NaN handling)
operators  DataFrame -> DataFrame operators (filters, aggregates, imputation,
           fixed-effect statistics, genotype codings, ensembles)
plans      multi-operator pipelines (phenotype table, feature blocks, model
           matrices, folds, model search / fit / predict)
"""

from trialspark.session import checkpoint_dir, get_spark, materialize, stage_scope

__all__ = ["get_spark", "checkpoint_dir", "materialize", "stage_scope"]
