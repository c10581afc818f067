"""Removal of repeated word windows, found level by level with doubled lengths.

A word goes if a window of ``WINDOW`` = 50 words covers it whose word sequence also starts in a
document with a smaller id.  Windows are found level by level: those repeated at one length alone are
extended to twice that length.  A level of 2 L words goes like this:

1. Every window picks the leftmost smallest hash among its L + 1 windows of L words, its seed.  Equal
   windows pick equal seeds at equal places, so a window can repeat only if its seed does.  At the first
   level, L = 25, seeds (about one position in thirteen) seen in one document alone drop out.  At later
   levels only windows are looked at of which every part of L words survived the level before.
2. The 2 L to 3 L words around a surviving seed hold all windows that picked it.  Where that whole
   context also starts in a smaller document, all of them repeat and are settled; of a context only the
   first document goes on.
3. For seeds still open, each window that picked it is hashed and compared.
4. Windows that occur in two documents survive.  Levels double until none does.

Removed words are the union of the windows of level 50 that also start in a smaller document.  Later levels
cannot add any, as a longer repeated window consists of repeated 50-word windows; they give each
document ``longest_level``, the longest length at which one of its windows also starts in a smaller one.

All comparisons are minimum aggregations by 128 bits of hash followed by a join on a written table, so a
passage that a third of the corpus shares is one combined row in the aggregate and a splittable
side in the join.

Edge cases: null text has no words; documents under 50 words have no window; equal rows of one id are
answered alike, and an id never counts as smaller than itself; rows of one id with unequal texts are
read as versions of one document, and a window repeated in either goes from both where it fits; rows
with a null id lose nothing and remove nothing; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .textvec import Words, span_hash, word_slices
from .workspace import Workspace, released, sifted, spread

WINDOW = 50


@dataclass
class Runs:
    """Runs lo to hi (both included) of window starts, as flat arrays; those of row r lie at ends[r] to ends[r + 1]."""

    lo: np.ndarray
    hi: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Runs:
        lists = [batch.column(c) for c in ("lo", "hi")]
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists[0]), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        return cls(*(x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists), ends)

    def placed(self, w: Words, a: int, b: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The runs of rows a to b - 1, which are those of ``w``, as word positions in ``w``; a run is cut to the windows of ``length`` words that its row has."""
        i, j = self.ends[a], self.ends[b]
        row = np.repeat(np.arange(b - a), np.diff(self.ends[a : b + 1]))
        lo, hi = self.lo[i:j] + w.first[row], np.minimum(self.hi[i:j] + w.first[row], w.first[row + 1] - length)
        return lo[lo <= hi], hi[lo <= hi]


def alive_windows(w: Words, runs: tuple[np.ndarray, np.ndarray] | None, length: int) -> np.ndarray:
    """Whether each window of 2 ``length`` words lies in one row and, if ``runs`` of surviving starts at
    ``length`` are given, all its parts of that length survived."""
    n = len(w.hash) - 2 * length + 1
    ok = w.row[:n] == w.row[2 * length - 1 :]
    if runs is None:
        return ok
    lives = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(lives, runs[0], 1)
    np.add.at(lives, runs[1] + 1, -1)
    dead = np.concatenate([[0], np.cumsum(np.cumsum(lives[:-1]) == 0)])
    return ok & (dead[length + 1 : length + 1 + n] == dead[:n])


def seeds(w: Words, length: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the seeds of ``length`` words, and the first and last start of the windows in a row that picked each."""
    start = np.flatnonzero(alive)
    if not len(start):
        return start, start, start
    g, _ = w.ngrams(length)
    at, width = np.arange(len(g)), 1
    while width < length + 1:  # leftmost argmin over stretches of growing width
        step = min(width, length + 1 - width)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(g[b] < g[a], b, a)
        width += step
    seed = at[start]
    i = np.flatnonzero(np.r_[True, (seed[1:] != seed[:-1]) | (start[1:] != start[:-1] + 1)])
    return seed[i], start[i], start[np.r_[i[1:] - 1, len(start) - 1]]


def _find_seeds(length: int, limited: bool):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = Runs.of(batch) if limited else None
            for a, b, w in word_slices(batch.column("text"), lower=False):
                if len(w.hash) < 2 * length:
                    continue
                ids = batch.column("doc_id").slice(a, b - a)
                seed, lo, hi = seeds(w, length, alive_windows(w, runs and runs.placed(w, a, b, length), length))
                row = w.row[seed] if len(seed) else np.zeros(0, np.int64)
                place = ((seed - lo).astype(np.uint64) << np.uint64(32)) ^ (hi - lo).astype(np.uint64)
                first = w.first[row]
                columns = [span_hash(w.hash, seed, seed + length), span_hash(w.hash, lo, hi + 2 * length) ^ place, span_hash(w.hash, lo, hi + 2 * length, second=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), *[pa.array(c.view(np.int64)) for c in columns], pa.array((lo - first).astype(np.int32)), pa.array((hi - first).astype(np.int32))],
                    names=["doc_id", "seed", "c1", "c2", "lo", "hi"],
                )

    return run


def _find_windows(length: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of the windows of ``length`` words that start in the runs."""
        for batch in batches:
            runs = Runs.of(batch)
            for a, b, w in word_slices(batch.column("text"), lower=False):
                lo, hi = runs.placed(w, a, b, length)
                n = hi - lo + 1
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                row = w.row[at] if len(at) else at
                hashes = [span_hash(w.hash, at, at + length, second=k) for k in (False, True)]
                ids = batch.column("doc_id").slice(a, b - a).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(h.view(np.int64)) for h in hashes], pa.array((at - w.first[row]).astype(np.int32))], names=["doc_id", "w1", "w2", "at"])

    return run


@released
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = Runs.of(batch)
        for a, b, w in word_slices(batch.column("text"), lower=False):
            total, removed, digests, texts = [], [], [], []
            raw = w.data.tobytes()
            gone = np.zeros(len(w.hash) + 1, np.int64)
            lo, hi = runs.placed(w, a, b, WINDOW)
            np.add.at(gone, lo, 1)
            np.add.at(gone, hi + WINDOW, -1)
            keep = np.cumsum(gone[:-1]) == 0
            for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                s, e = w.start[i:j][keep[i:j]].tolist(), w.end[i:j][keep[i:j]].tolist()
                kept = b" ".join([raw[x:y] for x, y in zip(s, e)])
                total.append(j - i)
                removed.append(j - i - len(s))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), batch.column("longest_level").slice(a, b - a), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "longest_level", "kept_text"])


def _per_document(spans: DataFrame, having: Column | None = None) -> DataFrame:
    """(doc_id, lo, hi): arrays of each different run, once however many equal rows an id has; of documents that meet the aggregate ``having``."""
    runs = spans.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"), (F.lit(True) if having is None else having).alias("wanted"))
    return runs.where("wanted").select("doc_id", F.col("runs.lo").alias("lo"), F.col("runs.hi").alias("hi"))


def _level(ws: Workspace, docs: DataFrame, runs: DataFrame | None, length: int) -> DataFrame:
    """(doc_id, lo, hi, later): starts of windows of 2 ``length`` words that occur in two documents; ``later`` says that they also start in a smaller one."""
    docs = docs if runs is None else sifted(docs, runs, "doc_id")
    found = (docs if runs is None else docs.join(runs, "doc_id")).mapInArrow(_find_seeds(length, runs is not None), "doc_id long, seed long, c1 long, c2 long, lo int, hi int")
    if runs is None:
        found = ws.save(found, "seeds")
        repeated = ws.save(found.groupBy("seed").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 < d1").select("seed"), "repeated")
        found = found.join(repeated, "seed")
    live = ws.save(found.select("doc_id", "c1", "c2", "lo", "hi"), "live")
    first = ws.save(live.groupBy("c1", "c2").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")), "contexts")
    split = ws.save(live.join(first, ["c1", "c2"]).select("doc_id", "lo", "hi", (F.col("doc_id") > F.col("d0")).alias("later"), (F.col("d0") < F.col("d1")).alias("shared")), "split")
    windows = ws.save(docs.join(_per_document(split.where("not later")), "doc_id").mapInArrow(_find_windows(2 * length), "doc_id long, w1 long, w2 long, at int"), "windows")
    least = ws.save(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 < d1").select("w1", "w2", "d0"), "least")
    hits = windows.join(least, ["w1", "w2"]).select("doc_id", F.col("at").alias("lo"), F.col("at").alias("hi"), (F.col("doc_id") > F.col("d0")).alias("later"))
    return ws.save(split.where("shared").select("doc_id", "lo", "hi", "later").unionAll(hits), f"level-{2 * length}")


def levels(ws: Workspace, docs: DataFrame, first: int = WINDOW) -> Iterator[tuple[int, DataFrame]]:
    """(length, surviving windows as of ``_level``) for ``first``, twice, four times ... words, until no candidate is left."""
    if first < 2 or first % 2:
        raise ValueError("the first length is twice that of its seeds")
    docs = docs.where("doc_id is not null")
    length, runs = first // 2, None
    while True:
        found = _level(ws, docs, runs, length)
        length *= 2
        yield length, found
        # a window of twice the length holds length + 1 starts in a row
        runs = ws.save(_per_document(found, F.max("hi") - F.min("lo") >= length), "runs")
        if not runs.head(1):
            return


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, longest_level, kept_text for each row of ``docs`` (doc_id, text)."""
    ws = Workspace(spark, "substring")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = longest = None
    for length, found in levels(ws, docs):
        reached = found.where("later").select("doc_id", F.lit(length).cast("long").alias("level"))
        spans, longest = (found.where("later"), reached) if spans is None else (spans, longest.unionAll(reached))
    known = _per_document(spans).join(longest.groupBy("doc_id").agg(F.max("level").alias("longest_level")), "doc_id")
    out = docs.join(known, "doc_id", "left").withColumn("longest_level", F.coalesce("longest_level", F.lit(0).cast("long")))
    return out.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, longest_level long, kept_text string")


def repeat_levels(spark: SparkSession, docs: DataFrame, first: int = WINDOW) -> DataFrame:
    """doc_id, level, n: the windows of ``first``, twice, four times ... words that occur in two documents or more."""
    out = None
    for length, found in levels(Workspace(spark, "levels"), docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), first):
        starts = found.select("doc_id", F.explode(F.sequence("lo", "hi")).alias("at")).distinct()
        part = starts.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(length).alias("level"), "n")
        out = part if out is None else out.unionAll(part)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")).drop("kept_text")
