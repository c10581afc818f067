"""The document pipeline: normalise, parse, chunk, detect headers, build sections and tree, run passes.

Each stage is a DataFrame of the ones before.  ``run`` writes them as Parquet under one folder,
reads back what later stages share, and adds an audit row per stage.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import catalog, chunk, enrich, headers, ingest, passes, sections, tree


@dataclass(frozen=True)
class Settings:
    target_tokens: int = chunk.TARGET
    overlap: int = chunk.OVERLAP
    ocr_threshold: float = 0.85
    weights: tree.Weights = tree.Weights()


def detect(chunks: DataFrame, typography: DataFrame | None = None) -> DataFrame:
    """Numbered headers of ``chunks``: candidates, boost by type, stitching, de-duplication, repair."""
    found = headers.candidates(chunks.withColumn("chunk_index", F.col("chunk_no") - 1))
    if typography is not None:
        found = found.join(typography.select("doc_id", "avg_size", "avg_weight"), "doc_id", "left")
        score, _ = headers.typography_boost(F.col("score"), F.col("avg_size"), F.col("avg_weight"))
        found = found.withColumn("score", score).drop("avg_size", "avg_weight")
    return headers.number(headers.repair(headers.dedupe(headers.stitch(found))))


def run(spark: SparkSession, docs: DataFrame, out: str, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """All stages over ``docs`` (doc_id, text), written under ``out``; returns the tables by name."""
    made: dict[str, DataFrame] = {}

    def stage(name: str, df: DataFrame) -> DataFrame:
        began = time.time()
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        made[name] = spark.read.parquet(f"{out}/{name}")
        catalog.audit_row(spark, out, name, "ok", time.time() - began).write.mode("append").parquet(f"{out}/audit")
        return made[name]

    pages = stage("pages", ingest.ocr_fallback(ingest.pages(docs), settings.ocr_threshold))
    blocks = stage("blocks", ingest.blocks(pages))
    images = stage("images", ingest.images(docs))
    rows = stage("table_rows", enrich.table_rows(pages))
    links = stage("links", enrich.links(pages, ["doc_id", "page_number"]))
    tables = enrich.tables(rows)
    stage("lists", enrich.list_items(blocks))
    stage("semantics", enrich.semantics(blocks, tables, images.select("doc_id", "page")))
    stage("order", enrich.reading_order(blocks.withColumn("index", F.col("block_no"))))
    stage("summary", enrich.parse_summary(pages, blocks, tables, links, images))
    _, typography = enrich.typography(blocks)
    chunks = stage("chunks", chunk.chunks(docs, settings.target_tokens, settings.overlap))
    found = stage("headers", detect(chunks, typography))
    assigned = sections.assign(found, chunks)
    parts = stage("sections", sections.sections(found, chunks, assigned))
    stage("section_map", sections.section_map(parts))
    nodes = stage("tree", tree.nodes(found, settings.weights))
    stage("gaps", tree.gaps(nodes))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("sentence_start", "chunk_index")) - 1
    corpus = parts.select("doc_id", idx.alias("idx"), F.col("section_id").alias("chunk_id"), "text", F.lit(None).cast("int").alias("token_count"), "sentence_start", "sentence_end", F.col("header_text").alias("header_path"))
    ranked = stage("ranked", passes.retrieve(spark, corpus))
    done = stage("passes", passes.results(spark, ranked))
    stage("pass_manifest", passes.manifest(done, out))
    made["audit"] = spark.read.parquet(f"{out}/audit")
    return made
