"""Every query against its SQL on the smallest tables."""

import pytest

from fundlens.plans.registry import load_all
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_matches_sql(spark, con, name):
    q = QUERIES[name]
    assert compare(spark, con, q.run, q.sql, SF) is None


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is None])
def test_runs(spark, name):
    assert QUERIES[name].run(spark, SF).count() >= 0
