"""Domain passes: retrieval per document and domain, context windows, citations and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as X
from . import search

BUDGET, HITS, CITED = 400, 12, 3
# fixed values: domains with their system and user prompts
PROMPTS = {
    "mechanical": (
        "You are a mechanical engineering analyst producing factual, cited summaries.",
        "Using the provided context, summarise mechanical design risks, loads, and interfaces. Cite chunk ids.",
    ),
    "electrical": (
        "You are an electrical engineering reviewer with expertise in power distribution, signal integrity, and safety compliance.",
        "Summarise electrical considerations, including power budgets, cabling, and safety constraints. Cite chunk ids.",
    ),
    "software": (
        "You are a software architecture reviewer focusing on APIs, telemetry, and risk mitigation.",
        "Summarise software behaviours, interfaces, and testing hooks. Cite chunk ids.",
    ),
    "controls": (
        "You are a controls engineer analysing loops, actuation, and fault detection strategies.",
        "Summarise control strategies, sensing, and monitoring requirements. Cite chunk ids.",
    ),
    "project_mgmt": (
        "You are a project/program manager highlighting risks, dependencies, and schedule impacts.",
        "Summarise programme risks, stakeholder actions, and next steps. Cite chunk ids.",
    ),
}
QUERY = "{} engineering insights"


def per_domain(rows: DataFrame) -> DataFrame:
    """``rows`` once for each domain, with domain, query, system, user and query_vector."""
    every = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(QUERY.format(d)).alias("query"), F.lit(s).alias("system"), F.lit(u).alias("user"), X.digest_vector(QUERY.format(d)).alias("query_vector")) for d, (s, u) in PROMPTS.items()])
    return rows.select("*", F.inline(every))


def retrieve(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    """Ranked chunks per (doc_id, domain); each document's chunks are the corpus.

    ``chunks`` is (doc_id, idx from 0, chunk_id, text, token_count, sentence_start, sentence_end,
    header_path), which is read once and shuffled once, by document.  At most HITS sparse and HITS dense hits are fused, then re-ranked with the flow,
    energy and graph scores.
    """
    c = search.grouped_bm25(chunks.where("doc_id is not null and idx is not null"), [QUERY.format(d) for d in PROMPTS])
    c = c.withColumn("flow_score", X.flow_score(F.col("token_count"), F.col("text"), F.col("sentence_start"), F.col("sentence_end")))
    c = c.withColumn("energy_score", X.energy_score(F.col("text"))).withColumn("graph_score", X.graph_score(F.col("header_path"))).withColumn("v", X.digest_embedding("text"))
    each = [F.struct(F.lit(d).alias("domain"), F.get("sparse", F.lit(i)).alias("sparse_score"), X.cosine(F.col("v"), X.digest_vector(QUERY.format(d))).alias("dense_score")) for i, d in enumerate(PROMPTS)]
    rows = c.select("*", F.inline(F.array(*each))).drop("sparse", "v")
    group = ["doc_id", "domain"]

    def hit(score: str) -> Column:
        """Whether a row is among the HITS best by a score, nulls last."""
        return F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), F.asc("idx"))) <= HITS

    rows = rows.withColumn("s", hit("sparse_score") & (F.col("sparse_score") > 0)).withColumn("d", hit("dense_score"))
    both = rows.where("s or d")
    for score, found in (("sparse_score", "s"), ("dense_score", "d")):
        both = both.withColumn(score, F.coalesce(F.when(F.col(found), F.col(score)), F.lit(0.0))).drop(found)
    both = both.withColumn("score", 0.5 * F.col("dense_score") + 0.5 * F.col("sparse_score"))
    rows = search.rank_by(both, group, HITS, [F.desc("score"), F.asc("idx")]).withColumnRenamed("rank", "fused_rank")
    rows = rows.withColumn("total_score", F.col("score") + 0.3 * F.col("flow_score") + 0.2 * F.col("energy_score") + 0.1 * F.col("graph_score"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("total_score"), "fused_rank")))


def window(ranked: DataFrame, budget: int = BUDGET, group: tuple[str, ...] = ("doc_id", "domain")) -> DataFrame:
    """The rows that make up each context: first non-blank row of a chunk id, then up to the budget.

    The first always stays; a row that would exceed the budget ends the window, as does one that
    reaches it.  ``ranked`` is (*group, rank, chunk_id, text, header_path).
    """
    r = ranked.withColumn("body", X.strip("text")).where((F.col("body") != "") & (F.coalesce("chunk_id", F.lit("")) != ""))
    r = r.withColumn("nth", F.row_number().over(Window.partitionBy(*group, "chunk_id").orderBy("rank"))).where("nth = 1")
    w = Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("tokens", X.word_count("body")).withColumn("total", F.sum("tokens").over(w)).withColumn("place", F.count("*").over(w))
    r = r.where((F.col("place") == 1) | (F.col("total") <= budget))
    prefix = F.when(F.coalesce("header_path", F.lit("")) != "", F.concat(F.lit("["), F.col("header_path"), F.lit("] "))).otherwise("")
    return r.withColumn("piece", F.concat(prefix, "body")).drop("nth", "body")


def contexts(ranked: DataFrame, budget: int = BUDGET, group: tuple[str, ...] = ("doc_id", "domain")) -> DataFrame:
    """*group, context: the window's pieces joined by empty lines."""
    rows = window(ranked, budget, group).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("rank", "piece"))).alias("p"))
    return rows.select(*group, F.array_join(F.transform("p", lambda x: x["piece"]), "\n\n").alias("context"))


def citations(ranked: DataFrame) -> DataFrame:
    """The first CITED ranked chunks of each (doc_id, domain)."""
    return ranked.where((F.col("rank") <= CITED) & (F.coalesce("chunk_id", F.lit("")) != "")).select("doc_id", "domain", "rank", "chunk_id", "header_path", "sentence_start", "sentence_end")


def results(spark: SparkSession, ranked: DataFrame) -> DataFrame:
    """One row per (doc_id, domain): pass id, answer, citations, retrieval trace, context, prompt, token counts."""
    docs = ranked.select("doc_id").distinct()
    trace = F.struct("rank", "chunk_id", "header_path", "score", "dense_score", "sparse_score", "flow_score", "energy_score", "graph_score", X.preview("text").alias("text_preview"))
    cite = F.when(F.col("rank") <= CITED, F.struct("rank", "chunk_id", "header_path", "sentence_start", "sentence_end"))
    lists = ranked.groupBy("doc_id", "domain").agg(F.array_sort(F.collect_list(cite)).alias("citations"), F.array_sort(F.collect_list(trace)).alias("retrieval"))
    rows = per_domain(docs).join(lists, ["doc_id", "domain"], "left").join(contexts(ranked), ["doc_id", "domain"], "left")
    rows = rows.withColumn("context", F.coalesce("context", F.lit("")))
    user = F.concat("user", F.lit("\n\nContext:\n"), "context")
    rows = rows.withColumn("user", user).withColumn("answer", F.trim(X.completion(F.col("user"), F.col("context"))))
    pass_id = F.concat(X.slug(F.col("doc_id").cast("string")), F.lit(":"), X.slug("domain"))
    return rows.select("doc_id", pass_id.alias("pass_id"), F.col("domain").alias("pass_name"), "answer", "citations", "retrieval", "context", "system", "user", F.lit("offline-synth").alias("provider"), X.word_count("context").alias("prompt_tokens"), X.word_count("answer").alias("completion_tokens"))


def manifest(done: DataFrame, root: str = "artifacts") -> DataFrame:
    """doc_id, passes: a map from pass name to its artifact's path."""
    path = F.concat(F.lit(f"{root}/"), F.col("doc_id").cast("string"), F.lit("/passes/"), X.slug("pass_name"), F.lit(".json"))
    return done.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pass_name", path)))).alias("passes"))
