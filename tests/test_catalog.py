"""Every query of the catalog against its SQL; those without SQL run and keep their columns."""

import pytest

from turnstone.plans import catalog

from .compare import connect, same_rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert same_rows(catalog.QUERIES[name](spark, SF), con, catalog.ORACLE_SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    out = catalog.QUERIES[name](spark, SF)
    assert len(set(out.columns)) == len(out.columns) and out.count() > 0


def test_every_sql_has_its_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and catalog.FLAGSHIP in catalog.QUERIES
