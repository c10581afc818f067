"""Driver tables as inputs of the operators, once as DataFrames and once as SQL.

The documents hold few of the structures the operators look for, so some inputs are derived from
other tables: texts with page and block breaks, header-like strings and rows of header series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small table that arrives in fewer partitions than there are cores, dealt out; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose line feeds are page breaks and whose sentence ends are block breaks."""
    d = documents(spark, sf_dir)
    text = F.replace(F.replace("text", F.lit("\n"), F.lit("\n\n\n")), F.lit(". "), F.lit(".\n\n"))
    return d.select("doc_id", F.concat(F.lit("[image:fig "), F.col("doc_id").cast("string"), F.lit("] "), text, F.when(F.col("doc_id") % 3 == 0, "\f[Image: b ]").otherwise("")).alias("text"))


PAGED = """raw AS (SELECT doc_id, '[image:fig ' || doc_id || '] ' || replace(replace(text, chr(10), repeat(chr(10), 3)), '. ', '.' || chr(10) || chr(10)) || CASE WHEN doc_id % 3 = 0 THEN chr(12) || '[Image: b ]' ELSE '' END AS text FROM documents),
seg0 AS (SELECT doc_id, string_split_regex(text, '\\f|\\n{3,}') a FROM raw),
seg AS (SELECT doc_id, unnest(a) AS segment, generate_subscripts(a, 1) AS page_number FROM seg0),
pg0 AS (SELECT doc_id, page_number, segment, regexp_replace(regexp_replace(segment, '(?i)\\[image:([^\\]]+)\\]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS body FROM seg),
pg AS (SELECT doc_id, page_number, segment, list_filter(list_transform(string_split_regex(body, '\\n{2,}'), lambda b: regexp_replace(b, '^\\s+|\\s+$', '', 'g')), lambda b: b <> '') AS blocks, len(regexp_extract_all(segment, '(?i)\\[image:([^\\]]+)\\]')) AS n_images FROM pg0)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: header-like strings of many kinds from orders."""
    o = table(spark, sf_dir, "orders")
    k, c, p, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    a, b, t = (k % 7).cast("string"), (c % 13).cast("string"), F.initcap(F.substring(p, 3, 20))
    kinds = [
        F.concat(F.lit("Appendix "), s, a, F.lit(" "), t),
        F.concat(a, F.lit("."), b, F.lit(" "), t),
        F.concat(b, F.lit(") "), t, F.lit(" loads and duty cycles of the pump set")),
        F.concat(s, a, F.lit("."), b, F.lit(" "), t),
        F.concat(F.lit("IV. "), t),
        F.concat(F.lit("Introduction to "), F.lower(p)),
        F.concat(F.upper(t), F.lit(" POWER SUPPLY")),
        F.concat(t, F.lit(" of "), b, F.lit(":")),
        F.concat(F.lit("section "), a, F.lit("-"), b),
        F.concat(F.lit("the "), F.lower(t), F.lit(" of "), b, F.lit(" units")),
    ]
    text = F
    for i, kind in enumerate(kinds):
        text = text.when(k % 10 == i, kind)
    return o.select(k.alias("doc_id"), text.alias("text"))


TITLES = """titles AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 10
 WHEN 0 THEN 'Appendix ' || o_orderstatus || a || ' ' || t
 WHEN 1 THEN a || '.' || b || ' ' || t
 WHEN 2 THEN b || ') ' || t || ' loads and duty cycles of the pump set'
 WHEN 3 THEN o_orderstatus || a || '.' || b || ' ' || t
 WHEN 4 THEN 'IV. ' || t
 WHEN 5 THEN 'Introduction to ' || lower(o_orderpriority)
 WHEN 6 THEN upper(t) || ' POWER SUPPLY'
 WHEN 7 THEN t || ' of ' || b || ':'
 WHEN 8 THEN 'section ' || a || '-' || b
 ELSE 'the ' || lower(t) || ' of ' || b || ' units' END AS text
 FROM (SELECT *, CAST(o_orderkey % 7 AS VARCHAR) a, CAST(o_custkey % 13 AS VARCHAR) b,
   array_to_string(list_transform(string_split(lower(substr(o_orderpriority, 3, 20)), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') t FROM orders))"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows from events: a document per user, a series per event type."""
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    n = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("user_id").alias("doc_id"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("chunk_id"), F.col("event_id").alias("chunk_index"), F.col("event_type").alias("section_key"),
        F.when(cents % 17 != 0, n % 25).alias("ordinal"), ((cents % 100) / 100.0).alias("score"), (n % 4 + 1).cast("int").alias("level"),
        F.concat(F.lit("Part "), (n % 25).cast("string"), F.when(n % 3 == 0, F.lit(" summary:")).otherwise(F.lit(". scope"))).alias("text"),
        (F.col("event_id") * 3).alias("sentence_start"), (F.col("event_id") * 3 + 1).alias("sentence_end"), F.lit(False).alias("recovered"),
    )


SERIES = """series AS (SELECT user_id AS doc_id, 'c' || event_id AS chunk_id, event_id AS chunk_index, event_type AS section_key,
 CASE WHEN cents % 17 <> 0 THEN n % 25 END AS ordinal, (cents % 100) / 100.0::DOUBLE AS score, CAST(n % 4 + 1 AS INT) AS level,
 'Part ' || (n % 25) || CASE WHEN n % 3 = 0 THEN ' summary:' ELSE '. scope' END AS text,
 event_id * 3 AS sentence_start, event_id * 3 + 1 AS sentence_end, false AS recovered
 FROM (SELECT *, CAST(round(value * 100) AS BIGINT) cents, CAST(json_extract_string(props, '$.k') AS BIGINT) n FROM events))"""
