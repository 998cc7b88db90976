"""Every query against the SQL that gives its rows; those without SQL give rows."""

from __future__ import annotations

import pytest
from oracle import assert_same, run_sql

from voxloom.plans import catalogue

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.SQL:
        assert_same(df, run_sql(SF, catalogue.SQL[name]))
    else:
        assert df.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
