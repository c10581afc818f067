"""Sentences and token-budgeted chunks with overlap."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X

TARGET, OVERLAP = 90, 12


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_no (from 0), sentence, tokens, heading."""
    s = docs.select("doc_id", F.posexplode(X.sentences(F.coalesce("text", F.lit("")))).alias("sentence_no", "sentence"))
    return s.select("doc_id", "sentence_no", "sentence", X.word_count("sentence").alias("tokens"), X.is_heading_sentence("sentence").alias("heading"))


def pack(tokens: list[int], heading: list[bool], target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(first, last) sentence of each chunk.

    A chunk ends once it holds ``target`` tokens or the next sentence is a heading.  The next one
    starts ``overlap`` tokens earlier, in whole sentences of mean length.  Zero means the default
    for both settings and the target is at least ten.
    """
    n = len(tokens)
    if not n:
        return []
    target, overlap = max(target or TARGET, 10), max(overlap or OVERLAP, 0)
    back = max(0, min(round(overlap / max(sum(tokens) / n, 1)), n - 1))
    out, start = [], 0
    while True:
        end, total = start, 0
        while end < n and total < target:
            total += tokens[end]
            end += 1
            if end < n and heading[end]:
                break
        out.append((start, end - 1))
        if end >= n:
            return out
        start = max(end - back, start + 1)


def chunks(docs: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_no, chunk_id, text, sentence_start, sentence_end, token_count of each chunk.

    Only the sequential walk over token counts runs in Python; it gets two small arrays per
    document, and the texts are cut in the JVM.  No shuffle: a document is one row throughout.
    """
    s = docs.select("doc_id", X.sentences(F.coalesce("text", F.lit(""))).alias("s"))
    s = s.select("doc_id", "s", F.transform("s", X.word_count).alias("tokens"), F.transform("s", X.is_heading_sentence).alias("heading")).where(F.size("s") > 0)

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def spans(tokens: pd.Series, heading: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in pack(list(t), list(h), target, overlap)] for t, h in zip(tokens, heading)])

    def cut(x: Column, k: Column) -> Column:
        size = x["b"] - x["a"] + 1
        return F.struct(
            (k + 1).alias("chunk_no"),
            F.array_join(F.slice("s", x["a"] + 1, size), " ").alias("text"),
            x["a"].alias("sentence_start"),
            x["b"].alias("sentence_end"),
            F.aggregate(F.slice("tokens", x["a"] + 1, size), F.lit(0), lambda acc, v: acc + v).alias("token_count"),
        )

    # the chunks are cut before they are exploded: no row ever carries the whole document more than once
    packed = s.withColumn("spans", spans("tokens", "heading")).select("doc_id", F.explode(F.transform("spans", cut)).alias("c"))
    name = F.format_string("%s:c%d", F.col("doc_id").cast("string"), F.col("c.chunk_no"))
    return packed.select("doc_id", "c.chunk_no", name.alias("chunk_id"), "c.text", "c.sentence_start", "c.sentence_end", "c.token_count")
