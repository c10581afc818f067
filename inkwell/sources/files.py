"""Payloads, JSON artifacts and JSONL tables as DataFrames, and the sinks that mirror them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def payloads(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content, size_bytes, sha256 of files; the hash is computed where the bytes are read.

    Spark lists no empty files, so an empty upload is absent rather than a row of size zero.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def within_limit(files: DataFrame, limit: int) -> DataFrame:
    """Non-empty files up to ``limit`` bytes; the length column is pruned before content is read."""
    return files.where((F.col("size_bytes") > 0) & (F.col("size_bytes") <= limit))


def texts(files: DataFrame) -> DataFrame:
    """doc_id (by content), text: UTF-8, or Latin-1 where the bytes are not UTF-8."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select(F.substring("sha256", 1, 12).alias("doc_id"), "path", text.alias("text"))


def inline_texts(spark: SparkSession, handles: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, text) handles given as strings."""
    return spark.createDataFrame(handles, "doc_id string, text string")


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole-file JSON artifacts; a corrupt file becomes a row of nulls."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank and malformed lines are dropped, a missing path is an empty table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines; ``by`` makes one folder per value, for few values only."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_texts(rendered: DataFrame, path: str) -> None:
    """Rendered artifacts (doc_id, value) as text files."""
    rendered.select("value").write.mode("overwrite").text(path)


def manifests(files: DataFrame, kind: str) -> DataFrame:
    """doc_id, artifact_path, kind, checksum, size, generated_at for artifacts (path, content)."""
    doc = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    return files.select(doc.alias("doc_id"), F.col("path").alias("artifact_path"), F.lit(kind).alias("kind"), F.sha2("content", 256).alias("checksum"), F.octet_length("content").cast("long").alias("size"), F.current_timestamp().alias("generated_at"))
