"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one in double precision; vectors that are equal then collapse to the
smallest id with a weight.  A rotation onto principal axes, fitted on a bounded sample (any rotation keeps
cosines, so the sample affects speed only), puts most of the norm into the leading dimensions.
Vectors, ordered by the first axis, form tiles of ``TILE`` rows, and consecutive tiles square cells of
a bounded number of bytes a side; a task compares the tiles of a cell.  For blocks of rows it
accumulates the products of the leading dimensions and bounds the
rest by the product of the suffix norms (one matrix product, the suffix norm being one more
column); pairs whose bound stays below the threshold stop there.  Survivors go on to more
dimensions, then to the cosine in double precision, taken of the vectors before rotation; cosines
within ``NEAR`` of the threshold are summed without intermediate rounding.  Cells whose ranges on
the first axis lie too far apart are never formed, tiles whose boxes on the first ``BOX`` axes do are skipped.

A task returns link counts per vector and a spanning forest of its links, never the pairs, so a
group of n copies costs O(n) rows per tile pair.  Every vector meets every other: the arithmetic
grows with the square of the rows unless the first axis separates them, as with any exact method
whose bound is the suffix norm; the rows moved grow as rows times cells on a side.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths link with nothing of another length; a null id links with
nothing; repeated rows of an id are answered alike and do not link with themselves; rows of one id
with unequal vectors are one node with the links of all of them; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import connected_components
from .workspace import Workspace

THRESHOLD = 0.9
TILE, BLOCK = 8192, 1024
LEADING = (0.25, 0.5)  # shares of the dimensions after which the bound is taken
SAMPLE, SAMPLE_BYTES = 20_000, 1 << 26
CELL_BYTES = 1 << 25  # of vectors on a side of a cell
BOX = 16
NEAR = 1e-9
_EPS = 1e-4  # above the rounding of single-precision products of unit vectors


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("embedding")
        bounds = lists.offsets.to_numpy()
        values = np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64)  # a null component reads as NaN
        usable = (pc.is_valid(lists).to_numpy(zero_copy_only=False)) & pc.is_valid(batch.column("vec_id")).to_numpy(zero_copy_only=False)
        units, keys, dims = [], [], []
        for a, b, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), usable.tolist()):
            x = values[a:b]
            top = np.abs(x).max() if ok and b > a else 0.0
            if np.isfinite(top) and top > 0:
                x = np.ldexp(x, -int(np.frexp(top)[1])) + 0.0  # a power of two, which rounds nothing
                units.append(x.tobytes())
                keys.append(hashlib.blake2b((x / np.sqrt(x @ x)).tobytes(), digest_size=16).digest())
                dims.append(b - a)
            else:
                units.append(None)
                keys.append(None)
                dims.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(units, pa.binary()), pa.array(keys, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "vector", "digest", "dim"])


def _rows(vectors: list[bytes], dim: int) -> np.ndarray:
    """Unit rows."""
    m = np.frombuffer(b"".join(vectors)).reshape(-1, dim)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Columns are the axes, by falling variance."""
    values, axes = np.linalg.eigh(np.cov(sample, rowvar=False).reshape(sample.shape[1], -1)) if len(sample) > 1 else (None, np.eye(sample.shape[1]))
    return np.ascontiguousarray(axes[:, ::-1])


def _lead(axis: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lead = _rows(batch.column("vector").to_pylist(), len(axis)) @ axis
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "weight", "vector")), pa.array(lead)], names=["rep", "weight", "vector", "lead"])

    return run


def _tiles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, weights, leads, rows = [], [], [], []

        def tile() -> pa.RecordBatch:
            u = b"".join(rows)
            name = hashlib.blake2b(np.array(ids).tobytes() + u, digest_size=8).digest()
            return pa.RecordBatch.from_arrays([pa.array([int.from_bytes(name, "little", signed=True)]), pa.array([min(leads)]), pa.array([max(leads)]), pa.array([np.array(ids).tobytes()], pa.binary()), pa.array([np.array(weights).tobytes()], pa.binary()), pa.array([u], pa.binary())], names=["tile", "lo", "hi", "ids", "weights", "u"])

        for batch in batches:
            for a, b, c, d in zip(*(batch.column(k).to_pylist() for k in ("rep", "weight", "lead", "vector"))):
                ids.append(a)
                weights.append(b)
                leads.append(c)
                rows.append(d)
                if len(ids) == size:
                    yield tile()
                    ids, weights, leads, rows = [], [], [], []
        if ids:
            yield tile()

    return run


class _Forest:
    """Labels of the nodes of a tile pair; each union costs one vector pass."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, nodes: np.ndarray) -> None:
        if (self.label[nodes] == self.label[nodes[0]]).all():
            return
        have = np.unique(self.label[nodes])
        if len(have) > 1:
            self.label[np.isin(self.label, have)] = have[0]


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    """With sums that round once, so that a cosine of exactly the threshold is not missed."""
    return math.fsum(a * b) / (math.sqrt(math.fsum(a * a)) * math.sqrt(math.fsum(b * b)))


def _reaches(u: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of u[i] and v[j] is at least the threshold."""
    a, b = u[i], v[j]
    value = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
    hit = value >= threshold
    for k in np.flatnonzero(np.abs(value - threshold) < NEAR).tolist():
        hit[k] = _cosine(a[k], b[k]) >= threshold
    return hit


def compare(x: np.ndarray, y: np.ndarray, same: bool, threshold: float = THRESHOLD, plain: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, links) for blocks of rows of x against all rows of y; links is a boolean matrix.

    ``plain`` holds the rows before rotation and scaling, on which links are decided.
    """
    u, v = plain or (x, y)
    dim = x.shape[1]
    cuts = sorted({max(1, int(dim * s)) for s in LEADING} - {dim})

    def bounded(m: np.ndarray, a: int, b: int) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, (m[:, b:] ** 2).sum(axis=1)))
        return np.concatenate([m[:, a:b], rest[:, None]], axis=1).astype(np.float32)

    first = cuts[0] if cuts else dim
    xa, ya = bounded(x, 0, first), bounded(y, 0, first)
    for r in range(0, len(x), BLOCK):
        block = x[r : r + BLOCK]
        open_ = xa[r : r + BLOCK] @ ya.T >= threshold - _EPS
        links = np.zeros(open_.shape, bool)
        i, j = np.nonzero(open_)
        if same:
            off = j != i + r
            i, j = i[off], j[off]
        if len(i) > open_.size // 16:
            value = block @ y.T
            links = (value >= threshold) & open_
            i, j = np.nonzero((np.abs(value - threshold) < NEAR) & open_)
            links[i, j] = _reaches(u, v, i + r, j, threshold)
            if same:
                links[np.arange(len(block)), np.arange(r, r + len(block))] = False
            yield r, links
            continue
        for p in range(0, len(i), 65536):
            a, b = i[p : p + 65536], j[p : p + 65536]
            for cut in cuts[1:]:
                xs, ys = bounded(block, 0, cut), bounded(y, 0, cut)
                live = np.einsum("ij,ij->i", xs[a], ys[b]) >= threshold - _EPS
                a, b = a[live], b[live]
            hit = _reaches(u, v, a + r, b, threshold)
            links[a[hit], b[hit]] = True
        yield r, links


def _cell(threshold: float, axes: np.ndarray):
    reach = 2 - 2 * threshold + 1e-9  # unit vectors with cosine t are no further apart, squared

    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Compares the tiles of a cell: those of its rows with those of its columns, each pair once."""
        parts = sorted(zip(*(table.column(c).to_pylist() for c in ("at", "ids", "weights", "u"))), key=lambda p: p[0])
        row, column = (k.as_py() for k in key)
        ids = {p[0]: np.frombuffer(p[1], np.int64) for p in parts}
        w = {p[0]: np.frombuffer(p[2], np.int64) for p in parts}
        u = {p[0]: np.frombuffer(p[3]).reshape(len(ids[p[0]]), -1) for p in parts}
        y = {at: np.ascontiguousarray((m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]) @ axes) for at, m in u.items()}
        box = {at: (m[:, :BOX].min(axis=0), m[:, :BOX].max(axis=0)) for at, m in y.items()}
        side = dict(zip(table.column("at").to_pylist(), table.column("side").to_pylist()))
        out = []
        for a in (at for at in ids if side[at] == row):
            for b in (at for at in ids if side[at] == column and at >= a):
                gap = np.maximum(0.0, np.maximum(box[a][0] - box[b][1], box[b][0] - box[a][1]))
                if gap @ gap <= reach:
                    out.append(_tile_links(a == b, (ids[a], ids[b]), (w[a], w[b]), (y[a], y[b]), (u[a], u[b]), threshold))
        return pa.table({c: np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i, c in enumerate(("rep", "links", "root"))})

    return run


def _tile_links(same: bool, ids: tuple, w: tuple, y: tuple, u: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, links, root in a spanning forest) of the linked rows of two tiles, or of one."""
    all_ids = ids[0] if same else np.concatenate(ids)
    counts, forest, shift = np.zeros(len(all_ids), np.int64), _Forest(len(all_ids)), 0 if same else len(ids[0])
    for r, links in compare(y[0], y[1], same, threshold, u):
        rows = np.flatnonzero(links.any(axis=1))
        if len(rows):
            counts[r + rows] += links[rows] @ w[1]
            if not same:
                counts[shift:] += w[0][r + rows] @ links[rows]
            for i in rows.tolist():
                forest.union(np.r_[r + i, shift + np.flatnonzero(links[i])])
    at = np.flatnonzero(counts)
    return all_ids[at], counts[at], all_ids[forest.label[at]]


def cells(spans: list[tuple[float, float]], side: int, reach: float) -> list[tuple[int, int]]:
    """For each run of ``side`` tiles, sorted by their low ends, its number and that of the last run in reach."""
    runs = [spans[i : i + side] for i in range(0, len(spans), side)]
    lows = [r[0][0] for r in runs]
    return [(i, bisect.bisect_right(lows, max(hi for _, hi in r) + reach) - 1) for i, r in enumerate(runs)]


def near_duplicate_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding)."""
    ws = Workspace(spark, "vectors")
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    unit = ws.save(source.mapInArrow(_normalised, "vec_id long, vector binary, digest binary, dim int"), "vector")
    # the weight counts distinct ids, so that repeated rows of an id are one vector
    once = unit.where("digest is not null").groupBy("digest", "vec_id").agg(F.min("vector").alias("vector"), F.any_value("dim").alias("dim"))
    reps = ws.save(once.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.min("vector").alias("vector"), F.any_value("dim").alias("dim")), "reps")
    found = None
    for d, n in sorted((r.dim, r.n) for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()):  # one row per vector length
        rows = reps.where(F.col("dim") == d)
        sample = rows.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < min(1.0, min(SAMPLE, SAMPLE_BYTES // (8 * d)) / n) * (1 << 30)).select("vector").collect()
        axes = principal_axes(_rows([r.vector for r in sample], d)) if len(sample) > 1 else np.eye(d)
        led = rows.select("rep", "weight", "vector").mapInArrow(_lead(np.ascontiguousarray(axes[:, 0])), "rep long, weight long, vector binary, lead double")
        groups = max(1, -(-n // tile))
        tiles = led.repartitionByRange(groups, "lead", "rep").sortWithinPartitions("lead", "rep").mapInArrow(_tiles(tile), "tile long, lo double, hi double, ids binary, weights binary, u binary")
        tiles = ws.save(tiles, "tiles")
        spans = sorted((r.lo, r.hi, r.tile) for r in tiles.select("tile", "lo", "hi").collect())  # one row per TILE vectors
        # unit vectors with cosine t lie within sqrt(2 - 2t) of each other on every axis
        reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
        wide = math.isqrt(8 * spark.sparkContext.defaultParallelism) + 1  # cells enough for all cores
        side = max(1, min(CELL_BYTES // (8 * d * tile), len(spans) // wide))
        plan = spark.createDataFrame(cells([(lo, hi) for lo, hi, _ in spans], side, reach), "a int, last int").select("a", F.explode(F.sequence("a", "last")).alias("b"))
        order = spark.createDataFrame([(t, i, i // side) for i, (_, _, t) in enumerate(spans)], "tile long, at int, side int")
        plan = plan.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("side")).join(order, "side")
        part = plan.hint("merge").join(tiles, "tile").select("a", "b", "side", "at", "ids", "weights", "u").groupBy("a", "b").applyInArrow(_cell(threshold, axes), "rep long, links long, root long")
        found = ws.save(part, "found") if found is None else found.unionAll(ws.save(part, "found"))
    if found is None:
        found = spark.createDataFrame([], "rep long, links long, root long")
    links = ws.save(found.groupBy("rep").agg(F.sum("links").alias("links")), "links")
    comp = ws.save(connected_components(ws, found.select(F.col("rep").alias("u"), F.col("root").alias("v"))), "components")
    known = reps.select("digest", "rep", "weight").join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    known = ws.save(known.select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known")
    return (
        unit.select("vec_id", "digest")
        .join(known, "digest", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
