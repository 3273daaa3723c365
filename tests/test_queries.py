"""Every query with SQL agrees with DuckDB."""

from __future__ import annotations

import pytest

from tessera.plans import relational, retrieval, streams  # noqa: F401
from tests.oracle import spark_rows, sql_rows

QUERIES = {**relational.QUERIES, **streams.QUERIES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf_dir))
    if name in relational.SQL:
        assert (columns, rows) == sql_rows(sf_dir, relational.SQL[name])
    else:
        assert columns


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
