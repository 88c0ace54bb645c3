"""Every registered query against its SQL on the smallest data set."""

import pytest
from check import compare, duck

from corpusmill.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, text = compare(spark, con, FOLDER, name)
    assert ok, text
