"""From raw text to pages, blocks and images; validation, checksums and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X

IMAGE = r"(?i)\[image:([^\]]+)\]"
MAX_BYTES = 50 * 1024 * 1024


def segments(docs: DataFrame) -> DataFrame:
    """doc_id, page_number, segment: text between form feeds or three or more line feeds."""
    parts = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\f|\n{3,}", -1)).alias("i", "segment"))
    return parts.select("doc_id", (F.col("i") + 1).alias("page_number"), "segment")


def pages(docs: DataFrame) -> DataFrame:
    """doc_id, page_number, text, blocks, n_images, coverage; blocks is an array of texts."""
    s = segments(docs).withColumn("body", X.strip(F.regexp_replace("segment", IMAGE, "")))
    s = s.withColumn("blocks", F.filter(F.transform(F.split("body", r"\n{2,}", -1), X.strip), lambda b: b != ""))
    images = F.size(F.regexp_extract_all("segment", F.lit(IMAGE), F.lit(1)))
    return s.select("doc_id", "page_number", F.array_join("blocks", "\n").alias("text"), "blocks", images.alias("n_images"), F.when(F.size("blocks") > 0, 1.0).otherwise(0.0).alias("coverage"))


def blocks(paged: DataFrame) -> DataFrame:
    """One row per block of ``pages`` with its id, box, font and confidence."""
    b = paged.select("doc_id", "page_number", F.posexplode("blocks").alias("i", "text"))
    font = F.struct(F.lit("SourceSans").alias("family"), F.lit(12.0).alias("size"), F.lit("normal").alias("weight"), F.lit("normal").alias("style"))
    return b.select(
        F.format_string("%s:p%d:b%d", F.col("doc_id").cast("string"), "page_number", F.col("i") + 1).alias("block_id"),
        "doc_id",
        F.col("page_number").alias("page"),
        (F.col("i") + 1).alias("block_no"),
        "text",
        F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))).alias("bbox"),
        font.alias("font"),
        F.lit(0.5).alias("confidence"),
    )


def images(docs: DataFrame) -> DataFrame:
    """doc_id, page, image_id, description of each image marker."""
    found = segments(docs).select("doc_id", "page_number", F.posexplode(F.regexp_extract_all("segment", F.lit(IMAGE), F.lit(1))).alias("i", "name"))
    return found.select("doc_id", F.col("page_number").alias("page"), F.format_string("%s:p%d:img%d", F.col("doc_id").cast("string"), "page_number", F.col("i") + 1).alias("image_id"), X.strip("name").alias("description"))


def doc_stats(paged: DataFrame) -> DataFrame:
    """Pages, blocks, images and mean coverage of each document."""
    return paged.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.sum(F.size("blocks")).alias("block_count"), F.sum("n_images").alias("images"), F.avg("coverage").alias("avg_coverage"))


def ocr_fallback(paged: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``paged`` plus ocr (page was recovered), with coverage and stub blocks after recovery.

    A document recovers its pages below the threshold only if its mean coverage is below it.
    """
    mean = F.avg("coverage").over(Window.partitionBy("doc_id"))
    todo = (mean < threshold) & (F.col("coverage") < threshold)
    p = paged.withColumn("ocr", todo)
    stub = F.array(F.lit("OCR recovered text"))
    filled = F.when(F.size("blocks") == 0, stub).otherwise(F.transform("blocks", lambda b: F.when(b == "", F.lit("OCR recovered text")).otherwise(b)))
    return p.select("doc_id", "page_number", "text", F.when(F.col("ocr"), filled).otherwise(F.col("blocks")).alias("blocks"), "n_images", F.when(F.col("ocr"), 1.0).otherwise(F.col("coverage")).alias("coverage"), "ocr")


def recovered_confidence(confidence: Column, ocr: Column) -> Column:
    return F.when(ocr, F.greatest(confidence, F.lit(0.72))).otherwise(confidence)


MAX_LABEL = 200


def validate_labels(uploads: DataFrame) -> DataFrame:
    """``uploads`` (doc_label, project_id, error) with both trimmed, empty ones null, and an error where a label is too long and nothing else is wrong."""
    out = uploads.withColumns({c: X.label(c) for c in ("doc_label", "project_id")})
    return out.withColumn("error", F.coalesce("error", F.when(F.char_length("doc_label") > MAX_LABEL, "invalid_doc_label")))


def validate(uploads: DataFrame, allowed: tuple[str, ...] = (".pdf",), offline: tuple[str, ...] = (".txt", ".text"), max_bytes: int = MAX_BYTES) -> DataFrame:
    """``uploads`` (file_id, file_name, upload_filename, size_bytes, is_direct) plus ``error``, null where accepted.

    ``size_bytes`` is null for a path that names no file.
    """
    direct = F.col("is_direct")
    suffix = lambda c: F.regexp_extract(F.lower(c), r"[^/.][^/]*?(\.[^./]*)$", 1)
    name, given = F.trim("file_name"), F.trim(F.coalesce("upload_filename", F.lit("uploaded.pdf")))
    direct_suffix = F.when(suffix(given) == "", F.lit(".pdf")).otherwise(suffix(given))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    error = (
        F.when(direct & ~(blank("file_id") & blank("file_name")), "direct_with_handle")
        .when(direct & (F.coalesce("size_bytes", F.lit(0)) == 0), "empty")
        .when(direct & (F.col("size_bytes") > max_bytes), "too_large")
        .when(direct & (given == ""), "blank_upload_name")
        .when(direct & ~direct_suffix.isin(*allowed), "unsupported_extension")
        .when(direct, None)
        .when(blank("file_id") & blank("file_name"), "no_handle")
        .when(F.col("file_id").isNotNull() & (X.strip("file_id") == ""), "blank_file_id")
        .when(X.strip("file_id").rlike(r"(?U)\s"), "space_in_file_id")
        .when(F.col("file_name").isNull(), None)
        .when(name == "", "blank_file_name")
        .when(name.contains("//"), "remote")
        .when(F.array_contains(F.split(name, "/"), ".."), "traversal")
        .when(name.rlike("[\n\r]"), "newline")
        .when(F.col("size_bytes").isNull(), "missing")
        .when(~suffix(name).isin(*allowed, *offline), "unsupported_extension")
        .when(F.col("size_bytes") > max_bytes, "too_large")
    )
    return uploads.withColumn("error", error)


def checksums(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` plus sha256 and size_bytes of the content column."""
    c = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    return files.withColumn("sha256", F.sha2(c, 256)).withColumn("size_bytes", F.octet_length(c).cast("long"))


HOT_ROWS, SALTS = 1_000_000, 64


def dedupe_uploads(files: DataFrame, order: str = "doc_id") -> DataFrame:
    """doc_id, sha256, status, owner: the first upload of a checksum is new, later ones duplicate it.

    The first is a combined minimum joined back.  Checksums of more than HOT_ROWS uploads, of which
    there are at most rows / HOT_ROWS, are broadcast as a list and salted, so that no task gathers one.
    """
    first = files.groupBy("sha256").agg(F.min(order).alias("owner"), F.min_by("size_bytes", order).alias("first_size"), F.count("*").alias("n"))
    hot = F.broadcast(first.where(F.col("n") > HOT_ROWS).select("sha256", F.lit(True).alias("hot")))
    salted = files.join(hot, "sha256", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(order), F.lit(SALTS))).otherwise(0))
    spread = F.when(F.col("n") > HOT_ROWS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    first = first.select("sha256", "owner", "first_size", F.explode(spread).alias("salt")).withColumn("salt", F.col("salt").cast("long"))
    status = F.when(F.col(order) == F.col("owner"), "new").when(F.col("size_bytes") != F.col("first_size"), "collision").otherwise("duplicate")
    return salted.join(first, ["sha256", "salt"]).select(F.col(order), "sha256", status.alias("status"), "owner")


def unseen(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files whose checksum is not in ``index`` (sha256)."""
    return files.join(index.select("sha256"), "sha256", "left_anti")


def upsert(records: DataFrame, key: str, version: str) -> DataFrame:
    """The latest record of each key; a blank key is rejected."""
    row = F.max_by(F.struct(*[c for c in records.columns if c != key]), version)
    good = records.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    return good.groupBy(key).agg(row.alias("r")).select(key, "r.*")


def unmanaged(files: DataFrame, events: DataFrame) -> DataFrame:
    """PDF paths without a write event."""
    return files.where(F.lower("path").endswith(".pdf")).join(events.select("path"), "path", "left_anti")
