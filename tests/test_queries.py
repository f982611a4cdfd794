"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import pytest

from headwater import catalogue

from .conftest import SMALL, duck, same_rows

CON = None


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, name):
    global CON
    CON = CON or duck(SMALL)
    same_rows(catalogue.queries()[name](spark, SMALL), CON, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
