import numpy as np
import pytest

from inkwell.llm import mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 1, 1]) == [100, 100, 100]
    t = mixing.targets([10, 1000, 1000], [5, 2, 1])
    assert t[0] == 30 and sum(t) == pytest.approx(2010) and t[1] == pytest.approx(2 * t[2])
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [5, 1]) == [0, 5]


def test_permutation_is_one():
    for n in (1, 2, 3, 64, 1000, 4097):
        for key in (1, 99):
            assert sorted(mixing.permute(np.arange(n), n, key).tolist()) == list(range(n))
    assert (mixing.permute(np.arange(1000), 1000, 1) != mixing.permute(np.arange(1000), 1000, 2)).any()


def test_shard_counts():
    totals = np.array([5050, 3030, 2020, 0, 1])
    for shards in (1, 2, 7, 100):
        every = list(mixing.shard_counts(0, shards, shards, totals))
        assert [k for k, _, _ in every] == list(range(shards)) and (sum(c for _, _, c in every) == totals).all()
        before = np.zeros_like(totals)
        for k, first, counts in every:
            assert (first == before).all() and (counts >= 0).all() and counts.sum() == (k + 1) * 10101 // shards - k * 10101 // shards
            before = before + counts
            ((_, again, same),) = mixing.shard_counts(k, k + 1, shards, totals)  # any task draws the same
            assert (again == first).all() and (same == counts).all()


def test_shard_counts_vary_like_a_multinomial():
    totals = np.array([30_000, 20_000, 10_000])
    counts = np.array([c for _, _, c in mixing.shard_counts(0, 600, 600, totals)])
    assert np.allclose(counts.mean(axis=0), [50, 100 / 3, 100 / 6])
    spread = counts.var(axis=0) / (100 * (totals / 60_000) * (1 - totals / 60_000))
    assert (abs(spread - 1) < 0.25).all()


def test_counts_beyond_the_generator():
    counts = np.array([3 * 10**9, 10**9, 7, 0])
    for left in (0, 1, 10**9 + 1, int(counts.sum()) - 1, int(counts.sum())):
        part = mixing.split(counts, left, np.random.default_rng(0))
        assert part.sum() == left and (part >= 0).all() and (part <= counts).all()


def test_mix_meets_its_targets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    rows = mixing.query(spark, small).collect()
    size = {r.doc_id: len((r.text or "").encode().split()) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    names = sorted(set(source.values()))
    totals = {s: sum(n for i, n in size.items() if source[i] == s) for s in names}
    want = dict(zip(names, mixing.targets([totals[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    taken = dict.fromkeys(names, 0)
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], totals[s]) and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(rows) == len(docs)
    for s in names:
        assert taken[s] == pytest.approx(want[s], rel=0.03)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.query(spark, small).collect()))


def test_taken_equals_the_listed_blocks(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    mix = mixing.Mix(spark, docs)
    streams, times = {}, {}
    for r in mix.rows.collect():
        streams.setdefault(r.sidx, []).extend([(r.first + k, r.doc_id) for k in range(r.size)])
    for r in mix.slots.collect():
        times[r.sidx, r.block] = times.get((r.sidx, r.block), 0) + 1
    want = {}
    for s, words in streams.items():
        assert sorted(p for p, _ in words) == list(range(len(words)))
        for p, i in words:
            want[i] = want.get(i, 0) + times.get((s, p // mix.block), 0)
    assert {r.doc_id: r.taken for r in mix.taken().collect() if r["size"]} == want


def test_odd_rows(spark, odd, none):
    rows = mixing.Mix(spark, odd).taken().collect()
    assert len(rows) == 11 and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert {r.taken for r in rows if r.doc_id in (0, 1, 2)} == {0} and sum(r.doc_id == 3 for r in rows) == 2
    assert mixing.Mix(spark, none).taken().count() == 0


def test_repeated_rows_have_places_of_their_own(spark):
    rows = [(7, "a", "x y z")] * 3000 + [(None, "a", "x y")] * 1500 + [(i, "b", "w " * 50) for i in range(40)] + [(7, "b", "x y z"), (7, "a", "x")]
    mix = mixing.Mix(spark, spark.createDataFrame(rows, "doc_id long, source string, text string"))
    got = mix.taken().collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    for source, size in (("a", 9000 + 3000 + 1), ("b", 2003)):
        own = [r for r in got if r.source == source]
        assert sum(r["size"] for r in own) == size and abs(sum(r.taken for r in own) - own[0].target) <= 64
    places = sorted((r.sidx, r.first, r["size"]) for r in mix.rows.collect())
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:]))


def test_slots_are_dealt_over_tasks(spark):
    rows = [(i, f"s{i % 3}", "w " * 2000) for i in range(400)]
    mix = mixing.Mix(spark, spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert mix.slots.rdd.getNumPartitions() == 4 and mix.slots.count() == sum(r.n for r in mix.slots.groupBy("shard").count().selectExpr("count AS n").collect())
