"""Plan shape: pushdown, pruning, no row-at-a-time Python, no unbounded windows or Cartesian products."""

import re

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from trialspark.operators import trial_stats as TS
from trialspark.plans import phenotype as PH
from trialspark.sources import fixtures as V


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_projection_reach_the_scan(spark):
    df = E.queries()["filter_years"](spark, SF_SMALL).select("Hybrid")
    s = df._jdf.queryExecution().optimizedPlan().toString()
    p = plan(df)
    assert "PushedFilters" in p or "DataFilters" in p
    # only the columns the query needs are read
    read = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert "l_extendedprice" not in read and "l_tax" not in read
    assert "Filter" in s


def test_no_row_at_a_time_python_in_any_checked_query(spark):
    for name in ["outlier_flag", "blue_replicated", "features_meta", "impute_group_mean",
                 "weather_mean_strict", "first_per_env", "column_profile", "geno_additive",
                 "geno_dominance", "folds_contiguous", "ensemble_weighted3", "train_matrix"]:
        p = plan(E.queries()[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in p, name
        assert "ArrowEvalPython" not in p, name


def test_imputation_and_outliers_use_no_window(spark):
    p1 = plan(E.queries()["impute_group_mean"](spark, SF_SMALL))
    p2 = plan(TS.outlier_flag(PH.plot_rows(V.trial(spark, SF_SMALL))))
    assert "Window" not in p1
    assert "Window" not in p2


def test_only_one_row_sides_are_cartesian(spark):
    for name in ["geno_additive", "geno_dominance", "geno_impute", "ensemble_weighted3"]:
        p = plan(E.queries()[name](spark, SF_SMALL))
        # cross joins only against a global aggregate (one row), always broadcast
        assert "CartesianProduct" not in p, name


def test_marker_statistics_leave_a_task_as_vectors(spark):
    """Summed per task before the one shuffle, by block of markers, and added after it; no cell is exploded."""
    p = plan(E.queries()["allele_freq"](spark, SF_SMALL))
    summed, exchange, added = (p.rindex("MapInArrow"), p.index("Exchange hashpartitioning(block"), p.index("MapInArrow"))
    assert added < exchange < summed and p.count("Exchange") == 1
    assert p.count("Generate ") == 1 and p.index("Generate ") < added


@pytest.mark.parametrize("name", ["weather_mean_strict", "replicate_counts", "impute_group_mean"])
def test_aggregates_are_partial_before_the_shuffle(spark, name, monkeypatch):
    from trialspark.operators import joins as J

    written, write = [], J.materialize  # the side tables are aggregated where they are written
    monkeypatch.setattr(J, "materialize", lambda df, side: (written.append((side, plan(df))), write(df, side))[1])
    p = plan(E.queries()[name](spark, SF_SMALL))
    if name == "impute_group_mean":
        p = dict(written)["group_means"]
    assert "partial_" in p, name


def test_fit_cell_stage_is_partially_aggregated(spark, monkeypatch):
    written = {}
    orig = TS.materialize

    def capture(df, name="stage"):
        written[name] = plan(df)
        return orig(df, name)

    monkeypatch.setattr(TS, "materialize", capture)
    TS.blue_replicated(V.trial(spark, SF_SMALL).filter("Yield_Mg_ha is not null"))
    cells = written["fe_cells"]
    assert "partial_" in cells and "Window" not in cells


@pytest.mark.parametrize("name", ["join_weather", "join_meta", "impute_group_mean", "semi_locations"])
def test_plot_rows_are_not_shuffled_to_meet_a_small_table(spark, name):
    """Also where the static planner may not broadcast: the written side's size decides."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(E.queries()[name](spark, SF_SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in p
    assert "Exchange hashpartitioning" not in p and "SortMergeJoin" not in p


def test_folds_are_attached_without_a_shuffle(spark):
    from trialspark.plans import folds as FO
    rows = V.trial(spark, SF_SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(FO.leave_one_group_out(rows, "Year"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in p


def test_stage_tables_go_with_their_scope(spark):
    import os

    from trialspark.session import materialize, stage_scope

    with stage_scope(spark) as paths:
        assert materialize(spark.range(5), "inner").count() == 5
        inner = [p.removeprefix("file:") for p in paths]
        assert len(inner) == 1 and os.path.isdir(inner[0])
    assert not os.path.exists(inner[0])
    assert materialize(spark.range(3), "outer").count() == 3
