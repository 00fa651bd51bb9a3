"""Every registered query against its SQL twin on the smallest tables."""

import os
import subprocess
import sys

import pytest

from tests.compare import compare, connect
from __spark_entry__ import entry, oracle_sql, queries
from threadlake.plans import load_all
from threadlake.plans.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


load_all()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    problem = compare(spark, duck, SF_DIR, QUERIES[name], ORACLES[name])
    assert problem is None, problem


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "message_count" in df.columns


def test_queries_are_read_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
