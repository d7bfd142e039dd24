"""Contract queries with SQL against DuckDB."""

import os

import duckdb
import pytest

from mnemolith.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = lambda x: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in x)
    want = con.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert rows(df.select(cols).collect()) == rows(want)
