"""Queries return the rows of every document."""

from collections import Counter

from inkwell.plans import queries_search as Q


def test_citations_of_every_document(spark, tiny):
    ranked = Counter((r.doc_id, r.domain) for r in Q.pass_ranked(spark, tiny).collect())
    got = Counter((r.doc_id, r.domain) for r in Q.pass_citations(spark, tiny).collect())
    assert got == {k: min(3, n) for k, n in ranked.items()}
    assert {i % 5 for i, _ in got} == {0, 1, 2, 3, 4}


def test_postings_hold_terms_that_occur_once(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    want = {(r.doc_id, t): n for r in docs for t, n in Counter((r.text or "").lower().split()).items()}
    got = {(r.doc_id, r.term): r.tf for r in Q.postings(spark, tiny).collect()}
    assert got == want and 1 in want.values()
