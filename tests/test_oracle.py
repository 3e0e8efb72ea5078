"""Every core query against its SQL on the smallest tables."""

import pytest

from kinmesh.plans import catalog

from .oracle import connect, difference

ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, small, con, name):
    assert difference(catalog.queries()[name](spark, small), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_runs(spark, small, name):
    assert catalog.queries()[name](spark, small).count() >= 0
