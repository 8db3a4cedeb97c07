"""The operators that SQL can state give the rows that DuckDB gives."""

import os

import pytest

from paperloom.llm import registry

duckdb = pytest.importorskip("duckdb")
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    df = registry.queries()[name](spark, DIR)
    cur = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows) for rows in (df.select(*columns).collect(), cur.fetchall()))
    assert got and got == want
