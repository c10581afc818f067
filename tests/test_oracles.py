"""Every query with SQL gives the same rows in Spark and in DuckDB."""

import datetime
import decimal
import glob

import duckdb
import pytest

from inkwell.plans import registry


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, bool) or x is None:
            return str(x)
        if isinstance(x, (int, float, decimal.Decimal)):
            return repr(round(float(x), 9) + 0.0)
        if isinstance(x, datetime.datetime):
            return x.isoformat()
        return str(x)

    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for path in glob.glob(f"{tiny}/*.parquet"):
        name = path.rsplit("/", 1)[1].removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, tiny, name):
    df = registry.QUERIES[name](spark, tiny)
    got_columns, got = canonical(df.collect(), df.columns)
    cur = duck.execute(registry.ORACLES[name])
    want_columns, want = canonical(cur.fetchall(), [c[0] for c in cur.description])
    assert got_columns == want_columns
    assert len(got) == len(want)
    assert got == want


def test_every_query_runs(spark, tiny):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLES)):
        assert registry.QUERIES[name](spark, tiny).count() >= 0, name


def test_sql_names_only_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
