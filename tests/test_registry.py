"""Every registered job against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as registry
from staywise.plans.catalog import jobs
from tests.compare_sql import LONG_RUNNING, connect, difference

STATEMENTS = {name: sql for name, sql in registry.oracle_sql().items() if name in jobs}


def test_every_statement_has_a_job():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and set(jobs) <= set(registry.queries())
    missing = set(jobs) - set(STATEMENTS)
    assert all(name.startswith(LONG_RUNNING) for name in missing)


def test_entry(spark):
    rows = registry.entry(spark).collect()
    assert sum(r["subscribers"] for r in rows) > 0


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_job_equals_sql(spark, small, duck, name):
    assert difference(spark, duck, small, name, STATEMENTS[name]) is None
