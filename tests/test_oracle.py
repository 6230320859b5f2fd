"""Registered queries against their SQL on the smallest tables, and that those without SQL return rows."""

import pytest

import __spark_entry__ as E
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = [k for k in E.queries() if not k.startswith(("op", "pipeline"))]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    sql = E.oracle_sql().get(name)
    if sql:
        assert compare(spark, con, name, E.queries()[name], sql, SF) is None
    else:
        assert E.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    got = E.entry(spark)
    assert got.columns == ["date", "clientes", "churn"] and got.count() > 0


def test_every_query_has_a_name_once():
    assert set(E.oracle_sql()) <= set(E.queries())
