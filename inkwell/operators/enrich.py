"""Facets of pages and blocks: links, tables, lists, roles, reading order, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as X

URL = r"(?U)https?://[\w\-._~:/?#\[\]@!$&'()*+,;=%]+"
BULLET = r"(?U)^(\d+\.|[\-*])\s+(.+)"


def links(pages: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``key``, link_no, url, start, end: offsets from the pieces between matches and the matches before."""
    found = F.regexp_extract_all(text, F.lit(f"({URL})"), F.lit(1))
    p = pages.select(*key, found.alias("urls"), F.split(text, URL, -1).alias("gaps")).where(F.size("urls") > 0)
    p = p.select(*key, F.posexplode(F.arrays_zip("urls", F.slice("gaps", 1, F.size("urls")).alias("gaps"))).alias("i", "m"))
    w = Window.partitionBy(*key).orderBy("i")
    gaps, before = F.sum(F.char_length("m.gaps")).over(w), F.sum(F.char_length("m.urls")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    start = gaps + F.coalesce(before, F.lit(0))
    return p.select(*key, (F.col("i") + 1).alias("link_no"), F.col("m.urls").alias("url"), start.alias("start"), (start + F.char_length("m.urls")).alias("end"))


def table_rows(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, row_no, cells of each line with a bar or tab and a non-blank cell."""
    p = pages.select("doc_id", "page_number", F.posexplode(X.lines("text")).alias("i", "line")).where(F.col("line").rlike(r"[\t|]"))
    p = p.withColumn("cells", F.filter(F.transform(F.split("line", r"[\t|]", -1), X.strip), lambda c: c != "")).where(F.size("cells") > 0)
    row = F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("i"))
    return p.select("doc_id", "page_number", row.alias("row_no"), "cells")


def tables(rows: DataFrame) -> DataFrame:
    """One table per page with rows: doc_id, table_id, page, rows; the number runs over the document."""
    per_page = rows.groupBy("doc_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda x: x["cells"]).alias("rows"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number"))
    return per_page.withColumn("n", n).select("doc_id", F.format_string("%s:p%d:tbl%d", F.col("doc_id").cast("string"), "page_number", "n").alias("table_id"), F.col("page_number").alias("page"), "rows")


def list_items(blocks: DataFrame, key: str = "block_id") -> DataFrame:
    """``key``, ordered, item_no, prefix, body of each bulleted or numbered line."""
    p = blocks.select(key, F.posexplode(F.filter(F.transform(X.lines("text"), X.strip), lambda s: s != "")).alias("i", "line")).where(F.col("line").rlike(BULLET))
    p = p.select(key, "i", F.regexp_extract("line", BULLET, 1).alias("prefix"), F.regexp_extract("line", BULLET, 2).alias("body"))
    w = Window.partitionBy(key)
    return p.select(key, F.min(F.col("prefix").endswith(".")).over(w).alias("ordered"), F.row_number().over(w.orderBy("i")).alias("item_no"), "prefix", "body")


def semantics(blocks: DataFrame, table_pages: DataFrame, image_pages: DataFrame) -> DataFrame:
    """block_id, role, confidence; the page tables are (doc_id, page), distinct."""
    t = table_pages.select("doc_id", "page").distinct().withColumn("has_table", F.lit(True))
    i = image_pages.select("doc_id", "page").distinct().withColumn("has_image", F.lit(True))
    s = X.strip("text")
    n = F.char_length("s")
    # fixed values: roles and their confidence, first match wins
    rules = [
        (F.col("s") == "", "empty", 0.2),
        (X.is_upper("s") & (n < 80), "heading", 0.85),
        (F.col("s").endswith(":"), "heading", 0.7),
        (F.col("s").startswith("-") | F.col("s").startswith("*"), "list_item", 0.75),
        (F.col("has_table").isNotNull(), "table_context", 0.55),
        (F.col("has_image").isNotNull() & (n < 120), "caption", 0.65),
    ]
    role, confidence = F, F
    for test, name, value in rules:
        role, confidence = role.when(test, name), confidence.when(test, value)
    out = blocks.withColumn("s", s).join(t, ["doc_id", "page"], "left").join(i, ["doc_id", "page"], "left")
    return out.select("block_id", "doc_id", "page", role.otherwise("paragraph").alias("role"), confidence.otherwise(0.6).alias("confidence"))


def reading_order(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc``, position, index: blocks by page, top, left and id as text; index is the block's place before."""
    w = Window.partitionBy(doc).orderBy("page", F.col("bbox")[1], F.col("bbox")[0], F.col("block_id").cast("string"), "index")
    return blocks.select(doc, (F.row_number().over(w) - 1).alias("position"), "index", "block_id")


def ocr_tokens(blocks: DataFrame, stats: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Blocks of documents that were recovered or lie below the coverage threshold, as tokens."""
    need = stats.where(F.col("ocr_performed") | (F.col("avg_coverage") < threshold)).select("doc_id")
    return blocks.join(need, "doc_id", "left_semi").select("doc_id", "block_id", "text", "confidence")


def parse_summary(pages: DataFrame, blocks: DataFrame, tables: DataFrame, links: DataFrame, images: DataFrame) -> DataFrame:
    """Counts of each facet and the language per document."""
    out = pages.groupBy("doc_id").agg(X.language(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), " ")).alias("language"))
    for name, facet in (("blocks", blocks), ("tables", tables), ("links", links), ("images", images)):
        out = out.join(facet.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left")
    return out.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("blocks", "tables", "links", "images")], F.col("language.code").alias("language"), F.col("language.confidence").alias("confidence"))


def typography(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per page sizes, per document mean size and weight with heading ids) of ``blocks`` with a font."""
    size, weight = F.col("font.size"), F.when(F.lower("font.weight").isin("bold", "700"), 700.0).otherwise(400.0)
    per_page = blocks.groupBy("doc_id", "page").agg(F.avg(size).alias("avg_size"), F.max(size).alias("max_size"), F.min(size).alias("min_size"))
    heading = F.when(X.is_heading_block("text", "font.size", "font.weight"), F.col("block_id"))
    return per_page, blocks.groupBy("doc_id").agg(F.avg(size).alias("avg_size"), F.avg(weight).alias("avg_weight"), F.sort_array(F.collect_list(heading)).alias("headings"))


def font_summary(spans: DataFrame, key: str) -> DataFrame:
    """Modal family (first seen wins ties), mean size, bold and italic by font name; spans have ``pos``."""
    families = spans.groupBy(key, "family").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    modal = families.groupBy(key).agg(F.max_by("family", F.struct("n", -F.col("pos"))).alias("family"))
    rest = spans.groupBy(key).agg(F.round(F.avg("size"), 2).alias("size"), F.bool_or(F.lower("family").contains("bold")).alias("bold"), F.bool_or(F.lower("family").rlike("italic|oblique")).alias("italic"))
    return rest.join(modal, key)
