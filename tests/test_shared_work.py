"""Work that the model queries do once: bins of the training rows, environments, the columns of the clean plots."""

import datetime

import numpy as np
import pytest

from trialspark.operators import binning as BI
from trialspark.plans import catalog as C
from trialspark.plans import matrices as MX
from trialspark.plans import model as MD
from trialspark.plans import phenotype as PH
from trialspark.sources import fixtures as V


def test_fold_schemes_share_the_bins(spark, monkeypatch):
    rows = spark.createDataFrame([("H1", 2019 + i % 3, "L1", "L1_1", f"H1_{i}", float(i), float(i % 4)) for i in range(20)],
                                 [*MX.TRAIN_KEYS, "x"])
    found, used = [], []
    find, write = BI.find_bins, BI.binned_blocks
    monkeypatch.setattr(C, "_model_rows", lambda *a: (rows, None))
    monkeypatch.setattr(BI, "find_bins", lambda *a: found.append(a[0].columns) or find(*a))
    monkeypatch.setattr(BI, "binned_blocks", lambda df, bins, *a: used.append(bins) or write(df, bins, *a))
    monkeypatch.setattr(MD, "search_binned", lambda data, *a: (None, None))
    monkeypatch.setattr(MD, "predict_binned", lambda model, data: data)
    a, b = C._fit_predict(spark, "", "raw", [("loyo", {}), ("contiguous", {})])
    assert len(found) == 1 and len(used) == 2
    assert a.bins.cuts[0].tolist() == b.bins.cuts[0].tolist() == [0.5, 1.5, 2.5]
    assert a.folds == [0, 1, 2] and b.folds == [0, 1, 2, 3, 4]


def test_small_batches_are_summarised_side_by_side(monkeypatch):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([float(i), None])], ["x"]) for i in range(5)]
    got = list(BI._wide_matrices(iter(batches), 1, 0))
    assert len(got) == 1 and got[0][0][::2].tolist() == [0, 1, 2, 3, 4] and np.isnan(got[0][0][1::2]).all()
    monkeypatch.setattr(BI, "MATRIX_BYTES", 32)
    assert [x.shape[1] for x in BI._wide_matrices(iter(batches), 1, 0)] == [4, 4, 2]


def test_clean_plots_hold_what_the_blues_need(spark, monkeypatch):
    plots = spark.createDataFrame(
        [(f"H{h}", "L1", y, f"L1_{y}", r, 1, 10.0 + h + r) for h in range(3) for y in (2018, 2019, 2024) for r in (1, 2)],
        "Hybrid string, Field_Location string, Year int, Env string, Replicate int, Block int, Yield_Mg_ha double")
    written = {}
    keep = PH.materialize
    monkeypatch.setattr(PH, "materialize", lambda df, name: written.setdefault(name, keep(df, name)))
    got = PH.phenotype_table(plots, spark.createDataFrame([("L1",)], "Field_Location string"))
    clean = written["clean_plots"]
    assert set(clean.columns) == {"Year", "Field_Location", "Hybrid", "Env", "Replicate", "Yield_Mg_ha"}
    assert [r["Year"] for r in clean.select("Year").distinct().collect()] == [2019]
    assert sorted((r["Hybrid"], r["Year"], r["Yield_Mg_ha"]) for r in got.collect()) == [
        (f"H{h}", 2019, pytest.approx(11.0 + h)) for h in range(3)]


def test_environments_are_made_distinct_before_they_are_named(spark, tmp_path):
    days = [datetime.datetime(1996 + i % 2, 5, 1) for i in range(6)]
    rows = [(i % 3 if i < 5 else None, 41 + i, d) for i, d in enumerate(days)]
    rows += [(2, None, datetime.datetime(V.TEST_SHIP_YEAR, 1, 2)), (2, 42, datetime.datetime(V.TEST_SHIP_YEAR, 3, 4)),
             (10, 82, datetime.datetime(V.TEST_SHIP_YEAR, 6, 7)), (None, 42, datetime.datetime(V.TEST_SHIP_YEAR, 6, 7))]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    meta = V.meta(spark, str(tmp_path))
    envs = [(r["Env"], r["m3"]) for r in meta.collect()]
    assert sorted(envs, key=str) == sorted(
        [("L0_2019", 19.0), ("L1_2020", 20.0), ("L2_2019", 19.0), ("L0_2020", 20.0), ("L1_2019", 19.0), (None, 20.0),
         ("L2_2024", 24.0), (None, 24.0)], key=str)
    assert "lineitem" not in meta._jdf.queryExecution().optimizedPlan().toString()
    assert not any("lineitem" in f for f in meta.inputFiles())
    template = [(r["Env"], r["Hybrid"]) for r in V.test_template(spark, str(tmp_path)).collect()]
    assert sorted(template, key=str) == sorted([("L2_2024", None), ("L2_2024", "H2"), (None, "H2")], key=str)
