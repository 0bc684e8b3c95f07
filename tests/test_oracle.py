"""Every registered query with a SQL twin gives the same rows."""

import pytest

import __spark_entry__ as entry
from tests.harness import ROOT, compare, duck

SF = f"{ROOT}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    assert compare(spark, name, SF, con) == ""


def test_every_query_is_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
