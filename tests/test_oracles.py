"""Every query against its SQL on the smallest test tables."""

import pytest

from fieldcheck.queries import ORACLES, QUERIES
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, text, _ = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert ok, text
