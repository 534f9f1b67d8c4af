"""Every query of the reference's operators against DuckDB SQL over the same tables."""

from __future__ import annotations

import pytest

from aislewise.plans import registry
from tests.compare import SMALL, SMALLEST, difference


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(registry.QUERIES[name](spark, SMALL), registry.SQL[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.SQL.keys()))
def test_query_without_sql_gives_rows(spark, name):
    df = registry.QUERIES[name](spark, SMALLEST)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_contract():
    import __spark_entry__

    assert registry.QUERIES.keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
