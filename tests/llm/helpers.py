"""DuckDB side of the SQL comparisons."""

import os

import duckdb

from tests.helpers import canon

TABLES = "documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def assert_same(df, con, sql):
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    want = canon(cols, res.fetchall())
    assert len(got) == len(want)
    assert got == want
