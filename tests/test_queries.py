"""Every query that has SQL against DuckDB on the same tables."""

import pytest

from loomgraph.plans import loop_queries as queries  # of all graphs


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["key", "consumers"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
