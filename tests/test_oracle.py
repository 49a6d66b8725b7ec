"""Every query with SQL gives DuckDB's rows."""

import pytest
from axisgrove import queries as own
from checks import same


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_same_rows(spark, sf_dir, name):
    same(own.queries()[name](spark, sf_dir), own.oracle_sql()[name], sf_dir)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
