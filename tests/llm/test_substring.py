import hashlib

import numpy as np

from inkwell.llm import substring


def brute(rows):
    first = {}
    words = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(words):
        w = words[i]
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert result(substring.query(spark, small)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_shared_passages_and_runs(spark):
    rng = np.random.default_rng(3)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 400, n)]
    passage, rows = words(70), []
    for i in range(60):
        at = rng.integers(0, 20)
        rows.append((i * 3 % 61, " ".join(words(at) + passage[: rng.integers(45, 70)] + words(30) + (["same"] * 130 if i % 4 == 0 else []) + passage)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(substring.remove_repeats(spark, docs)) == brute(rows)


def test_levels_double_until_none_survives(spark):
    rng = np.random.default_rng(8)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 300, n)]
    long, short = words(90), words(14)
    rows = [(i, " ".join(words(9) + (long[: 30 + 6 * i] if i < 9 else []) + words(5) + (short if i % 2 else []) + words(4))) for i in range(14)]
    got = {(r.doc_id, r.level): r.n for r in substring.repeat_levels(spark, spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()}
    want = {}
    for level in (10, 20, 40, 80):
        where = {}
        for i, t in rows:
            w = t.split()
            for p in range(len(w) - level + 1):
                where.setdefault(tuple(w[p : p + level]), []).append(i)
        for ids in where.values():
            if len(set(ids)) > 1:
                for i in ids:
                    want[i, level] = want.get((i, level), 0) + 1
    assert got == want and any(level == 40 for _, level in got)


def test_odd_rows(spark, odd, none):
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(spark, odd).collect()), key=str)
    assert len(got) == 11 and (5, 60000, 0) in got and (6, 60000, 60000) in got and (0, 0, 0) in got and got.count((3, 3, 0)) == 2
    assert substring.remove_repeats(spark, none).count() == 0


def test_versions_of_one_id_do_not_disturb(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(200))
    rows = [(1, a), (2, a), (2, b + " " + a), (2, "short"), (3, b)]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[0] == (1, 60, 0) and got[-1] == (3, 200, 200) and (2, 1, 0) in got and len(got) == 5


def test_longest_levels_and_repeated_rows(spark):
    rng = np.random.default_rng(11)
    words = lambda n: [f"v{x}" for x in rng.integers(0, 500, n)]
    passage, rows = words(900), []
    for i, n in enumerate((49, 50, 99, 100, 210, 399, 400, 640, 800, 900)):
        at = int(rng.integers(0, 900 - n + 1))
        rows += [(20 - i, " ".join(words(30) + passage[at : at + n] + words(30)))] * (40 if i in (3, 8) else 1)
    rows.append((3, " ".join(passage)))
    got = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in substring.remove_repeats(spark, got).collect()}
    texts = {i: t.split() for i, t in rows}
    want = brute(rows)
    for i, w in texts.items():
        longest, level = 0, 50
        while level <= len(w):
            smaller = {tuple(v[p : p + level]) for j, v in texts.items() if j < i for p in range(len(v) - level + 1)}
            longest = level if any(tuple(w[p : p + level]) in smaller for p in range(len(w) - level + 1)) else longest
            level *= 2
        assert found[i].longest_level == longest and (found[i].n_words, found[i].n_removed, found[i].kept_sha256) == want[i]
    assert {r.longest_level for r in found.values()} >= {0, 50, 100, 200, 400}
