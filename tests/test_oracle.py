"""Every catalog query against its SQL, on the smallest tables."""

import pytest
from check_oracle import compare, connect
from conftest import SF_SMALL

from riskloom.plans.catalog import catalog
from riskloom.plans.oracle import oracle


@pytest.fixture(scope="module")
def db():
    return connect(SF_SMALL)


def test_every_query_has_sql():
    assert set(catalog()) == set(oracle())


@pytest.mark.parametrize("name", sorted(catalog()))
def test_same_rows(spark, db, name):
    assert compare(spark, db, SF_SMALL, name) is None
