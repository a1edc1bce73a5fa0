"""Every registered query against its SQL on the smallest tables."""

import pytest

import check
from conftest import SF
from gistworks.plans.oracles import ORACLES
from gistworks.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return check.database(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict, rows, _, _ = check.compare(spark, con, SF, name)
    assert verdict == "ok"
    assert rows > 0
