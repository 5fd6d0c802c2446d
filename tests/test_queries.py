"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

from ledgerline.plans import oracles, standard
from tests.compare import duck, same_as_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(standard.queries()) == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query(spark, con, name):
    same_as_sql(standard.queries()[name](spark, SF), con, oracles.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
