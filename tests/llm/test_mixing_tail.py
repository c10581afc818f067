import numpy as np

from inkwell.llm import mixing


def test_small_sources_meet_their_targets(spark):
    sizes = [10, 100, 65, 40] * 30
    rows = [(i, f"s{i:03d}", "w " * n) for i, n in enumerate(sizes)] + [(1000, "z", "w " * 40_000)]
    taken = {r.doc_id: r for r in mixing.Mix(spark, spark.createDataFrame(rows, "doc_id long, source string, text string")).taken().collect()}
    small = [r for r in taken.values() if r.doc_id < 1000]
    assert all(r.target == 3 * r["size"] == r.taken for r in small)


def test_remainders_are_kept_on_average():
    sizes, want = [10] * 3000 + [100] * 3000, [25.0] * 3000 + [234.0] * 3000
    blocks = [-(-n // mixing.BLOCK) for n in sizes]
    slots = np.array(mixing.slots_wanted(sizes, want))
    for shards in (1, 7):
        total = sum(counts for _, _, counts in mixing.shard_counts(0, shards, shards, mixing.whole_slots(slots)))
        words = total * np.array(sizes) / blocks
        assert abs(words[:3000].mean() - 25) < 0.5 and abs(words[3000:].mean() - 234) < 2
        assert (abs(total - slots) < 1).all() and (total <= 3 * np.array(blocks)).all()
