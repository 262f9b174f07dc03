"""Every registered query against its SQL twin, and the driver contract."""

import pytest

import __spark_entry__ as contract
from tallyflow.plans import check, registry
from tests.conftest import SMALL

ORACLE = {name: sql for name, sql in contract.oracle_sql().items() if name in registry.QUERIES}


@pytest.fixture(scope="module")
def connection():
    return check.duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, connection, name):
    ok, note = check.compare(contract.queries()[name](spark, SMALL), connection, ORACLE[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(ORACLE)))
def test_query_without_sql_gives_rows(spark, name):
    assert contract.queries()[name](spark, SMALL).count() > 0


def test_every_sql_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_flags_sources(spark):
    flagged = contract.entry(spark)
    assert flagged.columns == ["srcAddr", "vlanID"] and flagged.count() > 0
