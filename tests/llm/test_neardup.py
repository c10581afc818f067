import numpy as np

from inkwell.llm import neardup


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """doc_id -> (set size, smallest id reachable)."""
    sets = {i: shingles(t) for i, t in rows}
    ids, up = sorted(sets), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_equals_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert result(neardup.query(spark, tiny)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_dense_group_of_variants(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(250):
        w = list(base)
        for p in rng.choice(150, rng.integers(0, 9), replace=False):
            w[p] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(neardup.near_duplicates(spark, docs)) == brute(rows)


def test_odd_rows(spark, odd):
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark, odd).collect()), key=str)
    assert len(rows) == 11
    by = {r[0]: r[1:] for r in rows}
    assert by[0] == (0, 0, True) and by[1] == (0, 1, True) and by[2] == (0, 2, True)
    assert by[3] == (1, 3, True) and by[4] == (1, 3, False) and by[None] == (1, None, True)
    assert by[5][1:] == (5, True) and by[6][1:] == (5, False)


def test_empty_table(spark, none):
    assert neardup.near_duplicates(spark, none).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    for j in (0.2, 0.5, 0.75, 0.9):
        n = 3000
        both = int(2 * n * j / (1 + j))
        pool = rng.integers(0, 2**64, 2 * n - both, dtype=np.uint64)
        a, b = pool[:n], pool[n - both :]
        ra, rb, ru = (neardup.registers(x, np.array([0, len(x)])) for x in (a, b, pool))
        assert (np.maximum(ra, rb) == ru).all()
        assert abs(neardup.estimate(ra, rb, np.array([float(n)]), np.array([float(n)]))[0] - j) < 0.2


def test_registers_do_not_depend_on_the_merge_size(monkeypatch):
    g, bounds = np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64), np.array([0, 0, 7, 3000, 5000])
    whole = neardup.registers(g, bounds)
    monkeypatch.setattr(neardup, "MERGE", 333)
    assert (neardup.registers(g, bounds) == whole).all()


def test_repeated_rows_and_versions_of_an_id(spark):
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(5, words(0, 60))] * 400 + [(9, words(0, 61)), (3, words(200, 260)), (9, words(200, 261)), (1, words(500, 540)), (9, words(800, 830))] + [(11, words(0, 62))] * 30 + [(12, None), (12, words(500, 541))]
    got = neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(got) == len(rows)
    ids = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert {c for (i, _), c in ids.items() if i in (3, 5, 9, 11)} == {3} and ids[1, 36] == ids[12, 37] == 1 and ids[12, 0] == 12
