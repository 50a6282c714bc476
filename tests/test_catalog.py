"""Every catalog query against its SQL."""

import pytest

from glossweave.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_agrees_with_sql(spark, sf_dir, duck, as_rows, name):
    assert as_rows(catalog.QUERIES[name](spark, sf_dir).toPandas()) == as_rows(duck.execute(catalog.ORACLE_SQL[name]).df())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_filters_and_columns_reach_the_scan(spark, sf_dir, capsys):
    catalog.QUERIES["q_entry_filter"](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan and "o_totalprice" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
