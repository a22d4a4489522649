"""Every registered query against its SQL on the smallest data set that gives it rows."""

import os

import pytest

from tests.compare import compare, connect
from tidewatch.plans import load_all

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
QUERIES, ORACLES = load_all()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data is not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, FOLDER, QUERIES[name], ORACLES[name], tolerance=1.01e-4)
    if problem == "empty on both sides":  # no evidence: ask for rows from more data
        problem = compare(spark, connect(LARGER), LARGER, QUERIES[name], ORACLES[name], tolerance=1.01e-4)
    assert problem is None, problem
