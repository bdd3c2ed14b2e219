"""Every query of the engine against its SQL equivalent, over the whole smallest tables."""

import pytest

from evidenza.plans import catalog
from tests.compare import connect, differ

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


def test_names():
    assert set(ORACLE) <= set(QUERIES)


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, small, con, name):
    assert differ(QUERIES[name](spark, small), con, ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert len(df.columns) == len(set(df.columns))
    df.collect()
