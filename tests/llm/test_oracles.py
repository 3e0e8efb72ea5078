"""The problems that SQL can state, against their SQL on the smallest tables; the others must run."""

import pytest

from kinmesh.llm.queries import ORACLE, QUERIES
from tests.oracle import connect, difference


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in ORACLE:
        assert difference(df, connect(small), ORACLE[name]) is None
    else:
        assert df.count() >= 0
