"""Every catalog query against its SQL."""

import compare
import pytest

import __spark_entry__ as driver
from flowsentry.plans import catalog

SF_DIR = "/root/testdata/sf0.01"
# Queries of other packages that the driver's list may hold have tests of their own.
ORACLES = {name: sql for name, sql in driver.oracle_sql().items() if name in catalog.QUERIES}
QUERIES = {name: query for name, query in driver.queries().items() if name in catalog.QUERIES}


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert compare.difference(QUERIES[name](spark, SF_DIR), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_alert_ids_are_stable_and_unique(spark):
    first = {tuple(row) for row in QUERIES["p11_alert_id"](spark, SF_DIR).collect()}
    again = {tuple(row) for row in QUERIES["p11_alert_id"](spark, SF_DIR).collect()}
    assert first == again
    assert len({row[2] for row in first}) == len(first)
