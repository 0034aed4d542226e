"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as e
from zephyrgrid.plans import load_all
from compare import compare, duck

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(load_all().QUERIES))
def test_query(spark, con, name):
    problem, rows = compare(spark, con, name, e.queries()[name], e.oracle_sql().get(name), FOLDER)
    assert problem is None and rows > 0, problem


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
