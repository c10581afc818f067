"""Queries that return more than their SQL, whose filter drops rows: equal on the rows that the SQL keeps, and on all rows without its filter."""

import pytest

from inkwell.plans import registry

from .test_oracles import canonical, duck  # noqa: F401

FILTERS = {"postings": ("tf > 1", " HAVING count(*) > 1"), "pass_citations": ("doc_id % 5 = 0", " AND doc_id % 5 = 0")}


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_equals_sql_but_for_its_filter(spark, duck, tiny, name):  # noqa: F811
    kept, clause = FILTERS[name]
    df = registry.QUERIES[name](spark, tiny).cache()
    for got, sql in ((df.where(kept), f"SELECT * FROM ({registry.ORACLES[name]}) WHERE {kept}"), (df, registry.ORACLES[name].replace(clause, ""))):
        cur = duck.execute(sql)
        assert canonical(got.collect(), got.columns) == canonical(cur.fetchall(), [c[0] for c in cur.description])
    df.unpersist()
