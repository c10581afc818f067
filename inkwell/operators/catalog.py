"""Document catalog: managed writes with events, stage audits, status, manifests of indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import ingest

AUDIT = T.StructType(
    [
        T.StructField("doc_set", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)
# fixed values: artifacts that a status may show
ARTIFACTS = ("normalize", "parse", "chunks", "headers", "sections", "tree", "gaps", "passes", "audit")


def audit_row(spark: SparkSession, doc_set: str, stage: str, status: str, seconds: float, **extra: object) -> DataFrame:
    """One audit record; null extras are dropped."""
    kept = {k: str(v) for k, v in extra.items() if v is not None}
    return spark.createDataFrame([(doc_set, stage, status, None, seconds * 1000.0, kept)], AUDIT).withColumn("at", F.current_timestamp())


def save_source(files: DataFrame, path: str) -> DataFrame:
    """Writes managed payloads (path, content) and returns their write events (path, sha256, size_bytes)."""
    events = ingest.checksums(files, "content")
    events.write.mode("append").parquet(path)
    return events.drop("content")


def visible(records: DataFrame, allowed: tuple[str, ...] = ARTIFACTS) -> DataFrame:
    """``records`` with the ``artifacts`` map reduced to allowed keys with a value."""
    return records.withColumn("artifacts", F.map_filter("artifacts", lambda k, v: k.isin(*allowed) & v.isNotNull()))


def inside(records: DataFrame, root: str, column: str = "path") -> DataFrame:
    """Rows whose path lies under ``root`` and does not climb out of it."""
    root = root.rstrip("/") + "/"
    return records.where(F.col(column).startswith(root) & ~F.array_contains(F.split(column, "/"), ".."))


def index_manifest(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_count, bm25_docs of the chunks that were indexed."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.count("text").alias("bm25_docs"))


def status(records: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The latest record of each asked document; unknown ones have a null status."""
    return doc_ids.join(ingest.upsert(records, "doc_id", "updated_at"), "doc_id", "left")
