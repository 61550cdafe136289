"""The numbered operators' queries against their SQL on the smallest test tables."""

import pytest

from fieldcheck.llm.queries import ORACLES, QUERIES
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    ok, text, _ = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert ok, text
