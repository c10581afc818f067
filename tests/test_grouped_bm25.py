"""Scores of several queries over documents that are corpora of their own, against a plain restatement."""

import math
from collections import defaultdict

from inkwell.operators import search

CHUNKS = [
    (1, 0, "Software insights for engineering software"),
    (1, 1, "controls and engineering"),
    (1, 2, "nothing of the kind"),
    (1, 3, None),
    (2, 0, "insights insights insights"),
    (2, 1, ""),
    (3, 0, "engineering " * 40 + "software"),
    (3, 1, "software engineering"),
    (3, 1, "software engineering"),
]
QUERIES = ["software engineering insights", "controls engineering engineering"]


def test_scores_equal_a_plain_restatement(spark):
    rows = spark.createDataFrame(CHUNKS, "doc_id long, idx int, text string")
    got = {(r.doc_id, r.idx, r.text): r.sparse for r in search.grouped_bm25(rows, QUERIES).collect()}
    docs = defaultdict(list)
    for d, i, t in CHUNKS:
        docs[d].append((i, t, (t or "").lower().split()))
    for d, chunks in docs.items():
        n, known = len(chunks), [w for _, t, w in chunks if t is not None]
        mean = sum(map(len, known)) / n
        for i, t, words in chunks:
            want = []
            for q in QUERIES:
                score = 0.0
                for term in q.split():
                    tf, df = words.count(term), sum(term in w for _, _, w in chunks)
                    if tf:
                        score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
                want.append(score)
            assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got[d, i, t], want)), (d, i, got[d, i, t], want)
    assert any(s > 0 for v in got.values() for s in v)


def test_no_chunks(spark):
    assert search.grouped_bm25(spark.createDataFrame([], "doc_id long, idx int, text string"), QUERIES).collect() == []
