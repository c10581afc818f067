"""Chunks to sections: as-of assignment, section text and section map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as X


def assign(headers: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_id, sentence_start, header_id: the last header at or before the chunk, else the first.

    One window over the union of both sides, so the as-of join costs a single shuffle on doc_id.
    Headers are (doc_id, header_id, sentence_start, chunk_index), chunks (doc_id, chunk_id, sentence_start).
    """
    h = headers.select("doc_id", F.col("sentence_start").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("chunk_index").cast("long").alias("tie"), F.lit(None).cast("string").alias("chunk_id"), "header_id")
    c = chunks.select("doc_id", F.col("sentence_start").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("tie"), "chunk_id", F.lit(None).cast("string").alias("header_id"))
    w = Window.partitionBy("doc_id")
    order = w.orderBy("at", "kind", "tie")
    u = h.unionByName(c).withColumn("now", F.last("header_id", ignorenulls=True).over(order)).withColumn("first", F.first("header_id", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return u.where("kind = 1").select("doc_id", "chunk_id", F.col("at").alias("sentence_start"), F.coalesce("now", "first").alias("header_id")).where("header_id is not null")


def sections(headers: DataFrame, chunks: DataFrame, assigned: DataFrame) -> DataFrame:
    """Each header with its chunk ids in order and the text of header and chunks joined by empty lines."""
    parts = assigned.join(chunks.select("doc_id", "chunk_id", "text"), ["doc_id", "chunk_id"])
    parts = parts.groupBy("doc_id", "header_id").agg(F.array_sort(F.collect_list(F.struct("sentence_start", "chunk_id", X.strip("text").alias("text")))).alias("parts"))
    h = headers.withColumnRenamed("text", "header_text").join(parts, ["doc_id", "header_id"], "left")
    ids = F.coalesce(F.transform("parts", lambda p: p["chunk_id"]), F.array().cast("array<string>"))
    texts = F.filter(F.concat(F.array(X.strip("header_text")), F.coalesce(F.transform("parts", lambda p: p["text"]), F.array().cast("array<string>"))), lambda t: t != "")
    return h.select("doc_id", "section_id", "header_id", F.array_join(texts, "\n\n").alias("text"), ids.alias("chunk_ids"), "header_text", "level", "score", "recovered", "sentence_start", "sentence_end", "chunk_index")


def section_map(sections: DataFrame) -> DataFrame:
    """section_id, header_id, chunk_id, order: chunks numbered through the document, from 0."""
    rows = sections.select("doc_id", "section_id", "header_id", "sentence_start", "chunk_index", F.posexplode("chunk_ids").alias("i", "chunk_id"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("sentence_start", "chunk_index", "i")) - 1
    return rows.select("doc_id", "section_id", "header_id", "chunk_id", n.alias("order"))
