"""Every registered query on the smallest tables, against SQL where there is any."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, small, name):
    problems, rows, _ = compare(spark, con, name, QUERIES[name], SQL[name], small)
    assert not problems
    assert rows > 0


# The other fits are covered by the model tests.
@pytest.mark.parametrize("name", ["t12_geo_fit", "m11_frozen_scoring", "x03_sampled_shapley", "x08_explanation"])
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_names():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert [r["fold"] for r in rows] == [1, 2, 3]


# Plans are read for queries that build lazily and cheaply.
LAZY = [n for n in sorted(SQL) if n[0] in "pdfe" or n.startswith(("a0", "a11", "a12", "x0", "v0", "t13", "t15"))]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
