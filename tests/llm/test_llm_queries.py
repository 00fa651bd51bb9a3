"""Queries of the subpackage against their SQL twins."""

import pytest

from tests.compare import compare, connect
from threadlake.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, name):
    assert compare(spark, duck, SF_DIR, QUERIES[name], ORACLES[name]) is None
