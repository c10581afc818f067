"""The operators that SQL can state give its rows."""

import glob

import duckdb
import pytest

from inkwell.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, tiny, name):
    con = duckdb.connect()
    for path in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    cur = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in cur.description]
    df = registry.QUERIES[name](spark, tiny)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(cur.fetchall())
