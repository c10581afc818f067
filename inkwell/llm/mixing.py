"""Mixing sources to target weights by fixed-length blocks and permuted indexes.

Each source is one stream of words, its documents in a fixed order, cut into blocks of ``BLOCK``
words.  Targets share all words by weight; a target stops at ``MAX_EPOCHS`` times its source and
the excess goes to the others.  A target is worth whole epochs of its source, taken outright, and a
remainder of target / (mean words of the source's blocks) slots; a fraction of a slot is rounded up or
down at random, so that it is kept on average.  The mix is a sequence of slots, one block each, cut
into output shards of ``SHARD_SLOTS``.  A shard's source counts are a multinomial draw, conditioned on
the totals of all shards, which keeps every source at its target: the slots are split in two, the
sources' counts of a half drawn from the multivariate hypergeometric distribution by a generator keyed by
seed and half, and so on down to single shards.  So any task draws its shards alone, with the place of
each in its source's slots, and reruns agree.  The j-th slot of a source maps to block ``perm(j mod n)``
under a pseudorandom permutation (a Feistel network with cycle walking) keyed by source and epoch, so a
block recurs only in another epoch.  Slots join blocks by (source, index).

Stream offsets come from two-level prefix sums over the distinct (source, id, size): they fall into about
sqrt(rows) hash chunks, so neither a hot source nor a repeated id nor the number of documents makes a
large window.  One row of each source reaches the driver, which plans the targets.

Edge cases: null text has size 0 and takes nothing; a null source is a source of its own, last in
order; null ids and repeated rows are answered row by row, each with a place of its own; an empty table gives an empty result; a
source without words has target 0; other columns are ignored.  Each source meets its target to within
a block, and exactly where the target is a whole number of epochs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .textvec import _WS, buffers, slices
from .workspace import Workspace, released, spread

BLOCK = 64
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 17
SHARD_SLOTS = 4096
TASK_SLOTS = 1 << 20  # most slots of a task
BROADCAST_SOURCES = 100_000  # totals of more sources are joined by a shuffle
COPIES = 1024  # rows that one row is unfolded to
_DRAWN = 10**9  # the generator draws from fewer slots than this


@released
def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        out = np.zeros(batch.num_rows, np.int64)
        for a, b in slices(offsets):
            d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            inside = ~_WS[d]
            begins = inside.copy()
            if len(d):
                border = np.zeros(len(d) + 1, bool)
                border[o] = True
                begins[1:] &= ~inside[:-1] | border[1:-1]
            out[a:b] = np.diff(np.r_[0, np.cumsum(begins)][o])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(out)], names=["doc_id", "source", "size"])


def targets(sizes: list[int], weights: list[float], cap: float = MAX_EPOCHS) -> list[float]:
    """Water-filling: min(cap * size, level * weight), summing to the sum of sizes."""
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if level * weights[i] > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = level * weights[i]
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The images of ``index`` under a pseudorandom permutation of range(n)."""
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    mask = np.uint64((1 << half) - 1)
    keys = np.random.Generator(np.random.Philox(key=key)).integers(1, 2**63, 4, dtype=np.uint64) | np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * (k | np.uint64(1))
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    x = once(index.astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def slots_wanted(sizes: list[int], want: list[float], block: int = BLOCK) -> list[float]:
    """Slots of each source whose words are its target on average: whole epochs, and the rest by mean block."""
    out = []
    for n, t in zip(sizes, want):
        epochs = min(MAX_EPOCHS, int(t // n)) if n else 0
        blocks = -(-n // block)
        out.append(epochs * blocks + max(0.0, t - epochs * n) * blocks / n if n else 0.0)
    return out


def whole_slots(slots: list[float], seed: int = SEED) -> np.ndarray:
    """Whole numbers of slots, rounded up with the fraction as probability."""
    return np.floor(np.array(slots, float) + np.random.Generator(np.random.Philox(key=seed)).random(len(slots))).astype(np.int64)


def split(counts: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source are among ``left`` of all slots, drawn without replacement.

    Beyond the generator's range counts are the rounded shares, from which chance would move a share by its 30000th.
    """
    total = int(counts.sum())
    if total < _DRAWN:
        return rng.multivariate_hypergeometric(counts, left, method="marginals")
    exact = counts * (left / total)
    out = np.minimum(np.floor(exact).astype(np.int64), counts)
    for i in np.argsort(out - exact, kind="stable"):
        if (rest := left - int(out.sum())) <= 0:
            break
        out[i] += min(rest, max(1, rest // len(out)), int(counts[i] - out[i]))
    return out


def shard_counts(begin: int, end: int, shards: int, totals: np.ndarray, seed: int = SEED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source in the shards before, slots of each source in it) of the shards begin to end - 1."""
    every = int(totals.sum())
    stack = [(0, shards, np.zeros_like(totals), totals)]
    while stack:
        lo, hi, before, counts = stack.pop()
        if hi <= begin or lo >= end:
            continue
        if hi - lo == 1:
            yield lo, before, counts
            continue
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, lo * (shards + 1) + hi]))
        part = split(counts, mid * every // shards - lo * every // shards, rng)
        stack += [(mid, hi, before + part, counts - part), (lo, mid, before, part)]


def _slots(shards: int, totals: np.ndarray, blocks: list[int], seed: int):
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            for shard, before, counts in shard_counts(int(ids[0]), int(ids[-1]) + 1, shards, totals, seed):
                sidx = np.flatnonzero(counts)
                slots, index = [], []
                for s in sidx.tolist():
                    slot, n = np.arange(before[s], before[s] + counts[s], dtype=np.int64), blocks[s]
                    at = np.empty(len(slot), np.int64)
                    for epoch in range(int(slot[0]) // n, int(slot[-1]) // n + 1):
                        of = slot // n == epoch
                        at[of] = permute(slot[of] % n, n, (seed << 80) | (s << 16) | epoch)
                    slots.append(slot)
                    index.append(at)
                if slots:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(counts.sum()), shard)), pa.array(np.repeat(sidx, counts[sidx])), pa.array(np.concatenate(slots)), pa.array(np.concatenate(index))], names=["shard", "sidx", "slot", "block"])

    return expand


class Mix:
    """A mix of ``docs`` (doc_id, source, text).

    ``rows`` has doc_id, size, sidx and the document's first word in its source's stream;
    ``sources`` the totals and targets; ``slots`` one row (shard, sidx, slot, block) per block taken.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, block: int = BLOCK, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED):
        ws = self.ws = Workspace(spark, "mixing")
        self.block = block
        sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(_sizes, "doc_id long, source string, size long")
        sized = ws.save(sized, "sizes")
        found = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()  # one row per source
        found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
        sizes = [r.n for r in found]
        want = targets(sizes, [weights[i % len(weights)] for i in range(len(found))])
        self.sources = spark.createDataFrame([(r.source, i, r.n, t) for i, (r, t) in enumerate(zip(found, want))], "source string, sidx long, source_size long, target double")
        self.few = len(found) <= BROADCAST_SOURCES
        chunks = max(1, math.isqrt(sum(r.docs for r in found)))
        at = sized.join(self._of_sources(F.col("source").alias("s"), "sidx"), F.col("source").eqNullSafe(F.col("s")))
        at = at.groupBy("sidx", "doc_id", "size").agg(F.count("*").alias("copies")).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(chunks)))
        at = ws.save(at.withColumn("words", F.col("size") * F.col("copies")), "distinct")
        before = Window.partitionBy("sidx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        sums = at.groupBy("sidx", "chunk").agg(F.sum("words").alias("n"))
        sums = ws.save(sums.select("sidx", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "chunks")
        inside = Window.partitionBy("sidx", "chunk").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        local = at.withColumn("within", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(sums, ["sidx", "chunk"])
        local = ws.save(local.select("doc_id", "size", "sidx", "copies", (F.col("base") + F.col("within")).alias("first")), "placed")
        many = local.where(F.col("copies") > COPIES).select("*", F.explode(F.expr(f"sequence(0, copies - 1, {COPIES})")).alias("from")).repartition("sidx", "doc_id", "size", "from")
        few = local.where(F.col("copies") <= COPIES).withColumn("from", F.lit(0).cast("long"))
        self.rows = few.unionByName(many).select("doc_id", "size", "sidx", "first", F.explode(F.expr(f"sequence(from, least(from + {COPIES}, copies) - 1)")).alias("copy"))
        self.rows = ws.save(self.rows.select("doc_id", "size", "sidx", (F.col("first") + F.col("copy") * F.col("size")).alias("first")), "rows")

        blocks = [-(-n // block) for n in sizes]
        totals = whole_slots(slots_wanted(sizes, want, block), seed)
        total = int(totals.sum())
        shards = -(-total // SHARD_SLOTS)
        tasks = max(1, min(shards, max(4 * spark.sparkContext.defaultParallelism, -(-total // TASK_SLOTS))))
        self.slots = spark.range(0, shards, 1, tasks).mapInArrow(_slots(shards, totals, blocks, seed), "shard long, sidx long, slot long, block long")

    def _of_sources(self, *columns) -> DataFrame:
        out = self.sources.select(*columns)
        return F.broadcast(out) if self.few else out

    def pieces(self) -> DataFrame:
        """(sidx, block, first, words): how many words of the document at ``first`` lie in each block."""
        b, last = self.block, F.col("first") + F.col("size")
        rows = self.rows.where("size > 0").select("sidx", "first", last.alias("last"), F.explode(F.sequence(F.floor(F.col("first") / b), F.floor((last - 1) / b))).alias("block"))
        return rows.select("sidx", "block", "first", (F.least("last", (F.col("block") + 1) * b) - F.greatest("first", F.col("block") * b)).alias("words"))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken for each document."""
        times = self.ws.save(self.slots.groupBy("sidx", "block").agg(F.count("*").alias("times")), "times")  # written, so that the planner knows its size
        taken = self.pieces().hint("merge").join(times, ["sidx", "block"]).groupBy("sidx", "first").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        rows = self.rows.withColumn("at", F.when(F.col("size") > 0, F.col("first")))
        rows = rows.join(taken.withColumnRenamed("first", "at"), ["sidx", "at"], "left").join(self._of_sources("*"), "sidx")
        return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(spark, spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")).taken().drop("source")
