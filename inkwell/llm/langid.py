"""Language identification: sparse multinomial logistic regression on character n-grams.

Texts become streams of lower-cased letters with single spaces in place of anything else; their
1- to 3-grams are hashed to ``FEATURES`` counters.  Weights are TF-IDF, scaled to length one; the
document frequencies come from all training documents.  The classifier is fitted by
follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties on a bounded sample:
``SAMPLE`` different texts of each language (all of them where there are fewer), those with the
smallest hashes.  Every fifth of a language is held out of the fit and sets the softmax temperature.

Training documents are those whose crc32(doc_id as text) mod 3 is not 1 and whose ``lang`` is not
null; only their text and lang are used.  A prediction sees the text alone.

Edge cases: null text, or text without a letter, gives ``und`` with score 0; without any training
document every text does; a null doc_id is never used for training and counts as not held out;
repeated rows are answered row by row, and equal texts of a language count once in the sample; a text
under two languages is a sample of both; an empty table gives an empty result; other columns are
ignored.  The number of languages is assumed to be small: one row each and ``SAMPLE`` sparse rows of at
most ``FEATURES`` counts reach the driver.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .sampling import smallest_keys
from .textvec import buffers, slices
from .workspace import released, small_batches, spread

FEATURES = 1 << 15
SLICE = 1 << 18  # bytes of text whose n-grams are in memory at once
ORDERS = (1, 2, 3)
SAMPLE = 1000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 1e-3, 1e-4
_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@functools.cache
def _letters() -> np.ndarray:
    """Code point to lower-case letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            y = x.lower()
            out[c] = ord(y) if len(y) == 1 else c
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature indexes of the rows' n-grams, row bounds, and whether a row has a letter."""
    rows = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
    x = _letters()[points]
    row = np.repeat(np.arange(rows), np.diff(at))
    keep = x != 0
    lettered = np.bincount(row[keep], minlength=rows) > 0
    keep[1:] |= (x[:-1] != 0) & (row[1:] == row[:-1])  # one space after each run of letters
    x, row = x[keep].astype(np.uint64), row[keep]
    idx, owner = [], []
    for n in ORDERS:
        k = len(x) - n + 1
        if k > 0:
            ok = row[:k] == row[n - 1 :]
            idx.append(_indexes(x, n)[ok])
            owner.append(row[:k][ok])
    if not idx:
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64), lettered
    flat, owner = np.concatenate(idx), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return flat[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=rows))], lettered


def _indexes(x: np.ndarray, n: int) -> np.ndarray:
    """Feature of each n-gram of a letter stream."""
    h = np.full(len(x) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ x[i : i + len(h)]) * _MIX[i]
        h ^= h >> np.uint64(29)
    return ((h * _MIX[0]) >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)


def long_counts(data: np.ndarray) -> tuple[np.ndarray, bool]:
    """Feature counts of one long text, and whether it has a letter, piece by piece."""
    counts, lettered, at, before, tail = np.zeros(FEATURES, np.int64), False, 0, 0, np.zeros(0, np.uint64)
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and data[end] & 0xC0 == 0x80:  # not inside a character
            end += 1
        x = _letters()[np.frombuffer(data[at:end].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
        keep = x != 0
        lettered |= bool(keep.any())
        keep |= np.r_[before, x[:-1]] != 0
        stream = np.r_[tail, x[keep].astype(np.uint64)]
        for n in ORDERS:
            new = stream[max(0, len(tail) - n + 1) :]
            if len(new) >= n:
                counts += np.bincount(_indexes(new, n), minlength=FEATURES)
        tail, before, at = stream[len(stream) - min(len(stream), max(ORDERS) - 1) :], x[-1], end
    return counts, lettered


def rows_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(features, their counts, has a letter) of each text."""
    data, offsets = buffers(texts)
    for a, b in slices(offsets, SLICE):
        part = data[offsets[a] : offsets[b]]
        if b == a + 1 and len(part) > SLICE:
            counts, lettered = long_counts(part)
            ids = np.flatnonzero(counts)
            yield ids, counts[ids], lettered
            continue
        idx, bounds, lettered = grams(part, offsets[a : b + 1] - offsets[a])
        for r in range(b - a):
            counts = np.bincount(idx[bounds[r] : bounds[r + 1]])
            ids = np.flatnonzero(counts)
            yield ids, counts[ids], bool(lettered[r])


@released
def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for found, _, _ in rows_of(batch.column("text")):
            df[found] += 1
            n += 1
    if n:
        yield from _df_rows(df, n)


def _df_rows(df: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    parts = [x.tobytes() for x in np.split(df, 64)] + [np.array([n]).tobytes()]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "df"])


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, df in zip(batch.column("part").to_pylist(), batch.column("df").to_pylist()):
            sums[part] = sums.get(part, 0) + np.frombuffer(df, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "df"])


@released
def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts = [], []
        for found, times, _ in rows_of(batch.column("text")):
            ids.append(found.astype(np.int32).tobytes())
            counts.append(times.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("lang"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["order", "lang", "ids", "counts"])


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # FEATURES x languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = counts * self.idf[ids]
        return (v / (np.linalg.norm(v) or 1.0)) @ self.weights[ids] + self.bias

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        e = np.exp((z - z.max(axis=-1, keepdims=True)) / self.temperature)
        return e / e.sum(axis=-1, keepdims=True)


def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The minimiser of a coordinate's linearised loss with elastic net, given its state."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], size: int, classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (size x classes) after FTRL-proximal steps with per-coordinate rates over (class, feature ids, values)."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    for _ in range(epochs):
        for y, ids, v in rows:
            zi, ni = z[ids], n[ids]
            w = weight(zi, ni)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p
            g2 = g * g
            z[ids] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / ALPHA * w
            n[ids] = ni + g2
    return weight(z, n)


def log_loss(logits: np.ndarray, y: np.ndarray, temperature: float) -> float:
    s = logits / temperature
    s = s - s.max(axis=1, keepdims=True)
    return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())


def temper(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature in 0.05 to 20 of the least log loss, by golden sections of its logarithm."""
    lo, hi = math.log(0.05), math.log(20.0)
    for _ in range(60):
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        lo, hi = (lo, b) if log_loss(logits, y, math.exp(a)) <= log_loss(logits, y, math.exp(b)) else (a, hi)
    return math.exp((lo + hi) / 2)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """A model of (lang, feature ids, counts): weights by ``ftrl``, temperature from every fifth row of a language."""
    langs = sorted({r[0] for r in rows})
    at = {c: i for i, c in enumerate(langs)}
    seen: Counter = Counter()
    train, held = [], []
    for row in rows:
        seen[row[0]] += 1
        (held if seen[row[0]] % 5 == 0 else train).append(row)
    prepared = []
    for lang, ids, counts in train:
        v = counts * idf[ids]
        prepared.append((at[lang], np.r_[ids, len(idf)], np.r_[v / (np.linalg.norm(v) or 1.0), 1.0]))
    w = ftrl(prepared, len(idf) + 1, len(langs))
    model = Model(langs, idf, w[:-1], w[-1])
    held = held or train
    model.temperature = temper(np.array([model.logits(ids, counts) for _, ids, counts in held]), np.array([at[r[0]] for r in held]))
    return model


def train(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from the training documents of ``docs`` (doc_id, text, lang); None if there are none."""
    small_batches(spark)
    usable = docs.where("doc_id is not null and lang is not null and text is not null")
    usable = usable.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("lang", "text", F.xxhash64("text").alias("key"))
    keys = smallest_keys(spark, usable, "lang", sample)
    if keys is None:
        return None
    parts = usable.select("text").mapInArrow(_document_frequencies, "part int, df binary")
    parts = parts.repartition(64, "part").mapInArrow(_sum_parts, "part int, df binary")
    summed: dict[int, np.ndarray] = {r.part: np.frombuffer(r.df, np.int64) for r in parts.collect()}  # 65 rows of fixed size
    n = int(summed.pop(64)[0])
    df = np.concatenate([summed[i] for i in range(64)])
    idf = np.log((1 + n) / (1 + df)) + 1
    chosen = usable.join(F.broadcast(keys), ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text"))
    rows = chosen.select(F.col("key").alias("order"), "lang", "text").mapInArrow(_sparse, "order long, lang string, ids binary, counts binary").collect()  # sample x languages rows at most
    rows.sort(key=lambda r: (r.order, r.lang))
    return fit([(r.lang, np.frombuffer(r.ids, np.int32).astype(np.int64), np.frombuffer(r.counts, np.int32).astype(float)) for r in rows], idf)


def _predictor(model: Model | None):
    if model is not None:
        model = Model(model.langs, model.idf, model.weights.astype(np.float32), model.bias, model.temperature)

    @released
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for ids, counts, lettered in rows_of(batch.column("text")):
                if not lettered or model is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                p = model.probabilities(model.logits(ids, counts))
                best = int(p.argmax())
                langs.append(model.langs[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return predict


def annotate(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (text and other columns, none named lang_pred or score) with lang_pred and score; a narrow pass."""
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_predictor(model), schema)


def identify(spark: SparkSession, docs: DataFrame, model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``; trains on ``docs`` if no model is given."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = model or train(spark, docs, sample)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out")
    return annotate(docs.select("doc_id", held, "text"), model).drop("text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark, spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id"))
