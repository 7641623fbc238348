"""Every query of the program-analysis engine against its statement in DuckDB."""

from __future__ import annotations

import pytest
from compare import check

from factweave.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, sf_dir, name):
    check(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


def test_entry_and_registry(spark, sf_dir):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.entry(spark).columns) == {"fn_id", "m1", "m2"}
