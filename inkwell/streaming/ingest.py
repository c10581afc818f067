"""Incremental ingest: new files become documents once per checksum, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

UPLOADS = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("uploaded_at", T.TimestampType())])


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines uploads that appear under ``path``."""
    return spark.readStream.schema(UPLOADS).json(path)


def first_seen(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The stream with one row per checksum within the watermark; state is bounded by ``delay``."""
    s = stream.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return s.withWatermark("uploaded_at", delay).dropDuplicatesWithinWatermark(["sha256"])


def event_counts(events: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts and sums of (ts, event_type, value) by tumbling window, late rows within ``delay`` included."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def to_table(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the stream to Parquet, exactly once by its checkpoint."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
