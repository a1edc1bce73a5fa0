"""The registered queries against their SQL."""

import pytest

import check
from conftest import SF
from gistworks.llm.oracles import ORACLES
from gistworks.llm.queries import QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(check.entry.queries())
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert check.compare(spark, check.database(SF), SF, name)[0] == "ok"
