"""Registered queries: names, and agreement with their SQL on the smallest tables."""

import re

import pytest

import __spark_entry__ as E
from trialspark.llm import queries as Q
from tests.conftest import SF_SMALL
from tests.llm.helpers import assert_same, connect


def test_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in Q.QUERIES) == list(range(1, 14))
    assert set(Q.ORACLE) <= set(Q.QUERIES) <= set(E.queries())
    assert "pipeline" in E.queries()


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_its_sql(spark, name):
    assert_same(Q.QUERIES[name](spark, SF_SMALL), connect(SF_SMALL), Q.ORACLE[name])
