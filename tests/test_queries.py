"""Every registered query against its SQL equivalent on the stored tables."""

import importlib

import pytest

import __spark_entry__ as driver
from tests import oracle

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    assert oracle.differences(driver.queries()[name](spark, SF), con, driver.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(driver.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert driver.queries()[name](spark, SF).count() > 0


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() == 32


def test_groups_do_not_reuse_names():
    from tallywarden import catalogue

    names = [
        n for g in catalogue.GROUPS for n in importlib.import_module(f"tallywarden.catalogue.{g}").QUERIES
    ]
    assert len(names) == len(set(names))
