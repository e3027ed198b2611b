"""Every registered query of the vector engine against its SQL."""

import pytest

from nearfield.plans.registry import ORACLES, QUERIES
from oracle_check import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], sf_dir) == ""


def test_entry_imports_and_answers(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 500
    assert set(entry.oracle_sql()) <= set(entry.queries())
