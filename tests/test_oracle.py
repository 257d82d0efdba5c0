"""Every registered query with an oracle matches DuckDB on the smallest scale factor."""

import os

import duckdb
import pytest

import __spark_entry__ as E
import oracle_sql
from trialspark.plans import catalog as C
from tests.conftest import SF_SMALL
from tests.helpers import canon

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
ORACLE = oracle_sql.queries()  # the training-data queries are compared in tests/llm


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from read_parquet('{p}')")
    return c


def test_every_query_has_a_name_in_the_catalog():
    qs = E.queries()
    assert set(ORACLE) <= set(E.oracle_sql()) <= set(qs)
    # only the model fits are rows-only
    assert {n for n in set(qs) - set(ORACLE) if n in C.QUERIES} == {
        "submission", "submission_env", "ensemble_learners", "ensemble_codings"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    want = canon(ocols, res.fetchall())
    assert sorted(df.columns) == sorted(ocols)
    assert len(got) == len(want)
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "Yield_Mg_ha" in df.columns
