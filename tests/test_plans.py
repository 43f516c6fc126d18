"""Every query with SQL gives what DuckDB gives; the others run and keep their columns."""

import pytest

from brightfold import plans

from .conftest import rows, sql_rows

plans.load()


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, sf, duck, name):
    assert rows(plans.QUERIES[name](spark, sf)) == sql_rows(duck, plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, sf, name):
    df = plans.QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0
