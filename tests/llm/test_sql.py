"""Every corpus query with an SQL twin gives the same rows, on the smallest tables."""

import duckdb
import pytest

from namelens.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "conversations", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(data):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    assert rows(df.select(*cols).collect()) == rows(rel.select(*cols).fetchall())
