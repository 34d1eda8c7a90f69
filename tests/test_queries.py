"""Every registered query of the library against its SQL; those without SQL give rows with a schema."""

import pytest
from oracle import assert_same, connect

from ragmill import plans


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(name, spark, sf, con):
    assert_same(plans.QUERIES[name](spark, sf), plans.ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_runs(name, spark, sf):
    assert plans.QUERIES[name](spark, sf).limit(5).toPandas().shape[1] > 0
