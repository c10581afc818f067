import numpy as np

from inkwell.llm import vectors


def brute(rows, t=0.9):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v, float)
            good[i] = x / np.linalg.norm(x)
    ids = sorted(good)
    up, n = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] >= t:
                n[a] += 1
                n[b] += 1
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (n[i], root(i)) for i, _ in rows}


def result(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def test_equals_brute_force(spark, small):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert result(vectors.query(spark, small)) == brute(rows)


def test_clusters_over_many_tiles(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    rows = [(i * 7 % 901, (centres[rng.integers(12)] * rng.uniform(0.5, 2) + rng.normal(size=24) * 0.28).tolist()) for i in range(400)]
    rows += [(2000 + i, rows[i][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = brute(rows)
    assert result(vectors.near_duplicate_vectors(spark, df, tile=64)) == want and sum(n for n, _ in want.values()) > 1000


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1e300, 1e300]), (10, [1.0, 1.0, 1.0]), (11, [-1.0, -1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, digest string, rep int")
    got = result(vectors.near_duplicate_vectors(spark, df.unionAll(df.where("vec_id = 7"))))
    assert got[7] == (2, 7) and got[8] == (2, 7) and got[9] == (2, 7)
    assert all(got[i] == (0, i) for i in (1, 2, 3, 4, 5, 6, 10, 11)) and got[None] == (0, None)
    assert vectors.near_duplicate_vectors(spark, df.limit(0)).count() == 0


def test_compare_stops_only_what_cannot_link():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 32)) * np.linspace(3, 0.1, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x @ vectors.principal_axes(x)
    got = np.concatenate([links for _, links in vectors.compare(y, y, True, 0.6)])
    want = x @ x.T >= 0.6
    np.fill_diagonal(want, False)
    assert (got == want).all() and want.any()


def test_pairs_at_the_threshold_are_links(spark):
    """Whole numbers whose cosine is exactly nine tenths, among many others that set the axes askew."""
    rng = np.random.default_rng(4)
    exact = [(0, [10.0, 0.0, 0.0, 0.0, 0.0]), (1, [9.0, 4.0, 1.0, 1.0, 1.0]), (2, [0.0, 10.0, 0.0, 0.0, 0.0]), (3, [4.0, 9.0, 1.0, 1.0, 1.0]), (4, [8.999999, 4.0, 1.0, 1.0, 1.0])]
    rows = exact[:4] + [(9, [-x for x in exact[4][1]]), (8, [-10.0, 0.0, 0.0, 0.0, 0.0])] + [(100 + i, (rng.normal(size=5) * [1, 3, 2, 9, 5]).tolist()) for i in range(300)]
    got = {r.vec_id: r for r in vectors.near_duplicate_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    m = np.array([x for _, x in rows])
    m /= np.linalg.norm(m, axis=1)[:, None]
    want = (m @ m.T >= 0.9 - 1e-13).sum(axis=1) - 1
    assert [got[i].n_links for i, _ in rows] == want.tolist() and got[1].component_id == 0 and got[3].component_id <= 2


def test_cells_of_several_tiles(spark, tiny):
    df = spark.read.parquet(f"{tiny}/embeddings.parquet")
    key = lambda r: r.vec_id
    whole = sorted(vectors.near_duplicate_vectors(spark, df).collect(), key=key)
    assert sorted(vectors.near_duplicate_vectors(spark, df, tile=4).collect(), key=key) == whole
    assert vectors.cells([(0.0, 0.1), (0.1, 0.2), (0.2, 0.3), (0.9, 1.0)], 2, 0.05) == [(0, 1), (1, 1)]
    assert vectors.cells([(0.0, 0.1), (0.1, 0.2), (0.2, 0.3), (0.9, 1.0)], 1, 0.05) == [(0, 1), (1, 2), (2, 2), (3, 3)]
