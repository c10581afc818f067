"""The corpus pipeline: ordered stages over documents, each calling one operator of ``inkwell.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkwell.llm import decontam, langid, mixing, neardup, secrets
from inkwell.llm.workspace import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language, that is without a letter."""
    docs = docs.select(COLUMNS)
    return langid.annotate(docs, langid.train(spark, docs)).where("lang_pred <> 'und'").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates, with every different text of it once.

    Of rows with equal id and text the one with the smallest other columns stays; rows without an id all stay.
    """
    docs = docs.select(COLUMNS)
    found = neardup.near_duplicates(spark, docs).where("doc_id is not null")
    kept = found.groupBy("doc_id").agg(F.min("kept").alias("kept")).where("kept").select("doc_id")
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return one.select("doc_id", "text", "rest.*").unionByName(docs.where("doc_id is null")).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its error budget."""
    return decontam.clean(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the text by a mark; ``n_chars`` follows."""
    clean = secrets.redacted(spark, docs.select(COLUMNS), secrets.ledger_folder(spark))
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix to target weights takes from each document."""
    return mixing.Mix(spark, docs).taken()


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mixing", mix),
]

#: No stage can be stated in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a written table."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
