import pytest

import __spark_entry__
from strandgraph.plans import catalog

from . import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, con, name):
    oracle.same(catalog.queries()[name](spark, oracle.DATA), con, catalog.oracle_sql()[name])


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
