"""Every query of the core against its SQL, or that it runs where SQL can't express it."""

import importlib

import pytest
from compare import differences, views

import __spark_entry__ as entry_module

MODULES = [importlib.import_module(name) for name in entry_module.CORE]
NAMES = sorted(name for module in MODULES for name in module.QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return views(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, con, name):
    df = entry_module.queries()[name](spark, sf_dir)
    sql = entry_module.oracle_sql().get(name)
    if sql:
        assert differences(df, sql, con) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
