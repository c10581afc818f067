"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and exact checks.

1. One pass gives each document its distinct five-word shingles and, from them, SetSketch
   registers: every shingle draws m ascending exponentials, dealt to registers by a permutation of
   its own; a register keeps the minimum h, stored as clip(floor(1 - log_b(h / a)), 0, 255).  These
   exponentially spaced truncated minima merge by maximum and agree with a probability close to
   the Jaccard similarity.
2. Documents with equal sets collapse to the smallest id, so exact copies never meet pairwise.
3. Runs of ``ROWS`` registers are bands.  Every member of a band's bucket is paired with the
   bucket's smallest member only, which is linear in the bucket.
4. Pairs whose jointly estimated similarity (maximum likelihood over the counts of greater,
   smaller and equal registers, given both set sizes) is far below the threshold go.
5. The rest are confirmed on their full sets; links give components.
6. Buckets that still hold several components compare every member outside the largest component
   with all members of other components.  Their documents get one finer sketch: ``FINE`` registers
   of which one hashed bit is kept, packed into long columns, so the join's own condition counts
   differing bits and only pairs within 4.5 standard errors of the threshold leave it, each in the
   first band it shares.  Those pass through 4 and 5.  So every pair that shares a band is in one
   component already, tested, or ruled out by its sketch, and no bucket is capped.

At similarity 0.75 a link shares no band with probability below 3e-6 (128 registers, 32 bands).

Edge cases: null or word-less text has an empty set and links with nothing; fewer than five words
form one shingle; a null doc_id is linked with nothing, has a null component_id and is kept;
repeated rows are answered row by row; rows of one id with different texts are versions of one document,
which has the links of all of them, while n_shingles is of the row; an empty table gives an empty result; only ``doc_id`` and
``text`` are read, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import connected_components
from .textvec import mix, shingle_sets, word_slices
from .workspace import Workspace, released, sifted, spread

SHINGLE, NUM, DEN = 5, 75, 100
REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
BASE, RATE = 1.1, 20.0
SLACK = 0.2  # five standard errors of the estimate at the threshold
FINE = 2048
WORDS = FINE // 64
MERGE = 1 << 20
_OFF = (1 - NUM / DEN) / 2  # share of one-bit registers that differ at the threshold
FINE_LIMIT = int(FINE * _OFF + 4.5 * (FINE * _OFF * (1 - _OFF)) ** 0.5)
_GOLD = 0x9E3779B97F4A7C15


def minima(g: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """The m exponential minima (rows x m) of the hash sets g[bounds[r]:bounds[r+1]].

    Elements leave as soon as their next exponential cannot lower any register of their row.
    """
    rows = len(bounds) - 1
    h = np.full(rows * m, np.inf)
    owner = np.repeat(np.arange(rows), np.diff(bounds))
    for a in range(0, len(g), MERGE):  # minima merge, so a large set needs no more memory than MERGE elements
        row = owner[a : a + MERGE]
        seed = mix(g[a : a + MERGE] ^ np.uint64(0x5851F42D4C957F2D))
        at, step = (seed & np.uint64(m - 1)).astype(np.int64), ((seed >> np.uint64(20)).astype(np.int64) & (m - 1)) | 1
        x = np.zeros(len(row))
        for j in range(m):
            u = ((mix(seed + np.uint64((j + 1) * _GOLD % 2**64)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            x -= np.log(u) / (m - j)
            np.minimum.at(h, row * m + ((at + j * step) & (m - 1)), x)
            live = x < h.reshape(rows, m).max(axis=1)[row]
            if not live.all():
                x, row, seed, at, step = x[live], row[live], seed[live], at[live], step[live]
            if not len(x):
                break
    return h.reshape(rows, m)


def registers(g: np.ndarray, bounds: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers (rows x m, uint8): truncated minima on an exponential scale."""
    k = np.floor(1.0 - np.log(minima(g, bounds, m) / RATE) / np.log(BASE))
    return np.clip(np.where(np.isfinite(k), k, 0), 0, 255).astype(np.uint8)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of register rows a and b, by joint maximum likelihood given the set sizes.

    With u = na/(na+nb), v = nb/(na+nb), a register of a exceeds b's with probability
    p(u - vJ), is below it with p(v - uJ), p(x) = -log_b(1 - x(b-1)/b); the log-likelihood is
    concave in J and its maximum is found by ternary search.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1.0 - u

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = (-np.log1p(-np.clip(x, 1e-12, 1.0) * (BASE - 1) / BASE) / np.log(BASE) for x in (u - v * j, v - u * j))
        return more * np.log(p) + less * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-12, None))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        c, d = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = likelihood(c) >= likelihood(d)
        lo, hi = np.where(left, lo, c), np.where(left, d, hi)
    return (lo + hi) / 2


@released
def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in word_slices(batch.column(1), lower=True):
            g, bounds = shingle_sets(w, SHINGLE)
            r = registers(g, bounds)
            digests = [hashlib.blake2b(g[i:j].tobytes(), digest_size=16).digest() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(np.diff(bounds), pa.int64()), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in r], pa.binary())],
                names=["doc_id", "n_shingles", "digest", "regs"],
            )


@released
def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in word_slices(batch.column("text"), lower=True):
            h = minima(*shingle_sets(w, SHINGLE), FINE)
            packed = np.packbits((mix(h.view(np.uint64)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("rep").slice(a, b - a), *[pa.array(packed[:, i]) for i in range(WORDS)]], names=["rep", *[f"s{i}" for i in range(WORDS)]])


@released
def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, REGISTERS) for k in ("ra", "rb"))
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in ("na", "nb"))
            yield batch.filter(pa.array(estimate(a, b, na, nb) >= NUM / DEN - SLACK)).select(["a", "b"])


@released
def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            sets: list[list[np.ndarray]] = [[], []]
            good = []
            for side, column in enumerate(("ta", "tb")):
                for _, _, w in word_slices(batch.column(column), lower=True):
                    g, bounds = shingle_sets(w, SHINGLE)
                    sets[side] += [g[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            for x, y in zip(*sets):
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                good.append(same > 0 and DEN * same >= NUM * (len(x) + len(y) - same))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])


def _texts(ws: Workspace, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of the different ids ``wanted``, a written table, with its other columns; each different version once."""
    return ws.save(sifted(docs, wanted, "doc_id").join(wanted, "doc_id").distinct(), "texts")


def _check(ws: Workspace, pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Links confirmed on full sets among the pairs that pass the estimate."""
    r = reps.select("rep", "n", "regs")
    joined = pairs.join(r.toDF("a", "na", "ra"), "a").join(r.toDF("b", "nb", "rb"), "b").where(f"least(na, nb) * {DEN} >= greatest(na, nb) * {NUM}")
    likely = ws.save(joined.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_likely, "a long, b long").distinct(), "likely")
    ends = likely.select(F.col("a").alias("doc_id"), F.lit(True).alias("is_a")).unionAll(likely.select("b", F.lit(False)))
    wanted = ws.save(ends.groupBy("doc_id").agg(F.max("is_a").alias("is_a"), F.max(~F.col("is_a")).alias("is_b")), "wanted")
    texts = _texts(ws, docs, wanted)
    full = likely.join(texts.where("is_a").select("doc_id", "text").toDF("a", "ta"), "a").join(texts.where("is_b").select("doc_id", "text").toDF("b", "tb"), "b")
    return ws.save(full.select("a", "b", "ta", "tb").mapInArrow(_confirmed, "a long, b long").distinct(), "links")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    ws = Workspace(spark, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = ws.save(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, digest binary, regs binary"), "signatures")
    reps = ws.save(
        sig.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("regs").alias("regs")), "reps"
    )
    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(regs, i * {ROWS} + 1, {ROWS})))")
    bands = reps.select("rep", "n", F.posexplode(keys).alias("band", "key"))
    buckets = ws.save(bands.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("k")).where("k > 1"), "buckets")
    shared = ws.save(bands.join(buckets, "key"), "shared")
    first = ws.save(shared.where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "pairs")
    links = _check(ws, first, reps, docs)
    # versions of one id are one document
    known = ws.save(sig.select("doc_id", "n_shingles", "digest").join(reps.select("digest", "rep"), "digest", "left").select("doc_id", "n_shingles", "rep"), "known")
    several = known.where("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    links = links.unionAll(known.join(several, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct())
    comp = ws.save(connected_components(ws, links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")

    members = shared.where("k > 2").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    members = ws.save(members.select("key", "band", "rep", "n", F.coalesce("component", "rep").alias("c")), "members")
    mixed = members.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "c")).alias("main"), F.count("*").alias("cs")).where("cs > 1")
    mixed = ws.save(mixed.select("key", F.col("main.c").alias("main")), "mixed")
    rest = ws.save(members.join(mixed, "key"), "rest")
    wanted = ws.save(rest.select("rep").distinct(), "wanted")
    texts = _texts(ws, docs, wanted.withColumnRenamed("rep", "doc_id")).withColumnRenamed("doc_id", "rep")
    fine = texts.mapInArrow(_bits, "rep long, " + ", ".join(f"s{i} long" for i in range(WORDS)))
    fine = ws.save(fine.join(reps.select("rep", keys.alias("keys")), "rep"), "fine")
    side = ws.save(rest.join(fine, "rep"), "sides")
    x = side.where("c <> main").select("key", *[F.col(c).alias(f"x_{c}") for c in side.columns if c != "key"])
    y = side.select("key", *[F.col(c).alias(f"y_{c}") for c in side.columns if c != "key"])
    near = (
        f"x_c <> y_c and (y_c = y_main or x_rep < y_rep) and least(x_n, y_n) * {DEN} >= greatest(x_n, y_n) * {NUM}"
        + f" and {' + '.join(f'bit_count(x_s{i} ^ y_s{i})' for i in range(WORDS))} <= {FINE_LIMIT}"
        + " and array_position(zip_with(x_keys, y_keys, (p, q) -> p = q), true) = x_band + 1"
    )
    cross = x.join(y, (x["key"] == y["key"]) & F.expr(near)).select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b"))
    cross = ws.save(cross.distinct().join(first, ["a", "b"], "left_anti"), "cross")
    more = _check(ws, cross, reps, docs)
    edges = comp.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(more.select("a", "b"))
    comp = ws.save(connected_components(ws, edges), "components")

    return (
        known.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id"))
