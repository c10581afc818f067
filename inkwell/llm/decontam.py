"""Benchmark decontamination by pigeonhole edit matching.

A text is compared in lower case, with its words (runs of letters and digits) joined by one space, so
case, punctuation and layout cost no edits.  An item of n characters has an error budget of k = floor(n * ERROR_RATE) edits and is
cut into k + 1 pieces.  If a stretch of a document lies within k edits of the item, at least one
piece occurs there exactly and no more than k characters from its place.  All pieces of a block of
items form one Aho-Corasick automaton; every hit opens a window of the document around it, windows
of an item that overlap are merged, and each is verified by Myers' bit-parallel distance, with the
item's characters as the bits of one integer.

Items are a stated query set: they are taken in blocks of bounded size, each block's automaton is
built once per worker, and documents are scanned whole, in place, without a shuffle.

Items of any length are searched.  One of fewer than ``SHORT`` characters has to occur exactly, and, so that
it is not found inside longer words, with no letter or digit next to its ends; scripts written
without spaces have no such borders.

Edge cases: null texts match nothing; items without letters and digits are empty and match nothing;
items with a null id or equal texts are searched like others; null document ids and repeated rows are answered row by row; empty tables give
an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .workspace import released, small_batches, spread

ERROR_RATE = 0.05
SHORT = 20
BLOCK_CHARS = 2_000_000
_BETWEEN = re.compile(r"[\W_]+")
#: Thai, Lao, Tibetan, Myanmar, Khmer, kana, ideographs
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
RESULT = "doc_id long, item_id long, distance long, budget long, start long, end long"


def normalise(text: str | None) -> str:
    return _BETWEEN.sub(" ", (text or "").lower()).strip()


def bordered(text: str, start: int, end: int) -> bool:
    """Whether no word of a spaced script runs over an end of text[start:end]."""
    return all(not 0 < at < len(text) or " " in (pair := text[at - 1 : at + 1]) or _UNSPACED.search(pair) for at in (start, end))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(item: str, masks: dict[str, int], text: str, limit: int) -> tuple[int, int] | None:
    """(distance, end) of the leftmost best match of the item in the text, if within the limit."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = (m, 0) if m <= limit else (limit + 1, -1)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= limit else None


def bit_masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | (1 << i)
    return out


class Matcher:
    """Finds the items (id, normalised text) of one block in normalised texts."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float = ERROR_RATE):
        self.items = [(i, t, int(len(t) * error_rate)) for i, t in items]
        self.reversed: dict[int, tuple[str, dict[str, int]]] = {}
        self.masks: dict[int, dict[str, int]] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for at, (_, text, k) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                places.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int, int, int]]:
        """(item id, distance, budget, start, end) of the best match of each item found."""
        windows: dict[int, list[tuple[int, int]]] = {}
        if len(self.automaton):
            for end, (length, where) in self.automaton.iter(text):
                start = end + 1 - length
                for at, offset in where:
                    _, item, k = self.items[at]
                    if k == 0 and len(item) < SHORT and not bordered(text, start, end + 1):
                        continue
                    windows.setdefault(at, []).append((max(0, start - offset - k), start - offset + len(item) + k))
        out = []
        for at, spans in windows.items():
            item_id, item, k = self.items[at]
            masks = self.masks.get(at) or self.masks.setdefault(at, bit_masks(item))
            best, a, b = None, None, None
            spans.sort()
            merged = [list(spans[0])]
            for x, y in spans[1:]:
                if x <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], y)
                else:
                    merged.append([x, y])
            for x, y in merged:
                hit = myers(item, masks, text[x:y], k)
                if hit and (best is None or hit[0] < best):
                    best, b = hit[0], x + hit[1]
                    if best == 0:
                        break
            if best is not None:
                back, back_masks = self.reversed.get(at) or self.reversed.setdefault(at, (item[::-1], bit_masks(item[::-1])))
                a = b - myers(back, back_masks, text[max(0, b - len(item) - best) : b][::-1], best)[1]
                out.append((item_id, best, k, a, b))
        return out


@functools.lru_cache(maxsize=1)
def _matcher(items: tuple[tuple[int | None, str], ...], error_rate: float) -> Matcher:
    """One automaton per Python worker, kept over the worker's tasks."""
    return Matcher(list(items), error_rate)


def _finder(items: tuple[tuple[int | None, str], ...], error_rate: float):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(items, error_rate)
        for batch in batches:
            rows = [(doc_id, *hit) for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")) for hit in matcher.find(normalise(text.as_py()))]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "budget", "start", "end"])

    return run


def blocks(items: DataFrame, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """The items with letters or digits, normalised, in blocks of at most ``limit`` characters (or one item)."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        text = normalise(row.text)
        if not text:
            continue
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((row.item_id, text))
        size += len(text)
    if block:
        yield block


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, distance, budget, start, end: the best match of each item in each document.

    ``start`` and ``end`` are code points of the normalised text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(spark)
    out = None
    for block in blocks(items):
        found = docs.mapInArrow(_finder(tuple(block), error_rate), RESULT)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], RESULT)


def _keeper(items: tuple[tuple[int | None, str], ...], error_rate: float):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(items, error_rate)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.find(normalise(t.as_py())) for t in batch.column("text")], pa.bool_()))

    return run


def clean(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` in which no item is found; one narrow pass for each block of items."""
    small_batches(docs.sparkSession)
    for block in blocks(items):
        docs = docs.mapInArrow(_keeper(tuple(block), error_rate), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
