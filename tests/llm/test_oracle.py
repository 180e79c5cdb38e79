"""Queries of this folder that SQL can state, against DuckDB."""

import duckdb
import pytest

from tests.llm.helpers import DATA
from trolley.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    result = queries.QUERIES[name](spark, DATA)
    assert sorted(result.columns) == sorted(columns)
    assert sorted(map(tuple, result.select(columns).collect())) == sorted(found.fetchall())
