"""Every query with an SQL twin gives the same rows, on the smallest tables."""

import duckdb
import pytest

from namelens.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("orders", "documents", "customer"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(columns, data):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) & set(catalog.ORACLE_SQL)))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    assert rows(cols, df.select(*cols).collect()) == rows(cols, rel.select(*cols).fetchall())
