"""Every registered query of the library against its DuckDB oracle (the driver's gate), at sf0.01."""

import pytest

import __spark_entry__ as entry
from hostshelf.plans import catalog
from tools.check_oracle import connect, difference

from conftest import SF01


@pytest.fixture(scope="module")
def con():
    return connect(SF01)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(entry.queries()) and set(catalog.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    got = catalog.queries()[name](spark, SF01).toPandas()
    assert difference(got, con.execute(catalog.oracle_sql()[name]).df()) == ""


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 50
    assert df.columns[0] == "id" and [r.id for r in rows] == sorted((r.id for r in rows), reverse=True)
