"""Sparse, dense and hybrid retrieval with exact top-k."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as X

K1, B = 1.5, 0.75


def term_df(docs: DataFrame) -> DataFrame:
    """term, df: documents that hold the term; distinct per document before the shuffle."""
    terms = docs.select(F.explode(F.array_distinct(X.tokens("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def postings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, term, tf; terms are counted before the shuffle."""
    return docs.select(key, F.explode(X.tokens("text")).alias("term")).groupBy(key, "term").agg(F.count("*").cast("int").alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """n_docs, total_tokens, avgdl in one row."""
    n = F.coalesce(F.sum(F.size(X.tokens("text"))), F.lit(0)).cast("long")
    s = docs.agg(F.count("*").alias("n_docs"), n.alias("total_tokens"))
    return s.withColumn("avgdl", F.when(F.col("total_tokens") == 0, 1.0).otherwise(F.col("total_tokens").cast("double")) / F.greatest("n_docs", F.lit(1)))


def idf(n: Column, df: Column) -> Column:
    return F.when(df > 0, F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))).otherwise(0.0)


def query_words(t: Column, wanted: list[str]) -> Column:
    """Length of the words ``t`` and the places of them among the ``wanted`` ones, in one pass."""
    places = F.array(*[F.lit(w) for w in wanted])
    return F.struct(F.size(t).alias("dl"), F.filter(F.transform(t, lambda w: F.array_position(places, w)), lambda p: p > 0).alias("p"))


def times_found(i: int) -> Column:
    """How often the word at place i was found by ``query_words``, whose result is column d."""
    return F.size(F.filter("d.p", lambda x: x == i + 1))


def bm25(docs: DataFrame, query: str, key: str = "doc_id") -> DataFrame:
    """``key``, score for every row of ``docs``; repeated query words count again.

    Two scans of the text, no shuffle of it: one aggregates length and document frequencies of the
    query's words into a single row, a scalar subquery; the other scores each document in place.
    """
    wanted = Counter(query.lower().split())
    tokens = docs.select(key, X.let(X.tokens(F.coalesce("text", F.lit(""))), lambda t: query_words(t, list(wanted))).alias("d"))
    counted = tokens.select(key, F.col("d.dl").alias("dl"), *[times_found(i).alias(f"tf{i}") for i in range(len(wanted))])
    stats = counted.agg(F.count("*").alias("n"), F.sum("dl").alias("total"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    one = stats.select(F.struct("*")).scalar()
    avgdl = F.when(one["total"] == 0, 1.0).otherwise(one["total"].cast("double")) / F.greatest(one["n"], F.lit(1))
    score = F.lit(0.0)
    for i, times in enumerate(wanted.values()):
        f = F.col(f"tf{i}")
        part = idf(one["n"], one[f"df{i}"]) * (f * (K1 + 1) / (f + K1 * (1 - B + B * (F.col("dl") / avgdl))))
        score = score + F.when(f > 0, times * part).otherwise(0.0)
    return counted.select(key, score.alias("score"))


def top(scored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k best by score, ties to the smaller key."""
    return scored.orderBy(F.desc("score"), key).limit(k)


def dense(vectors: DataFrame, query: Column, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, score: cosine of every vector with the query; vectors of another length raise."""
    same = F.size(vector) == F.size(query)
    score = F.when(same, X.cosine(F.col(vector), query)).otherwise(F.raise_error(F.lit("vector dimension differs from the query's")).cast("double"))
    return vectors.select(key, score.alias("score"))


def fuse(sparse: DataFrame, dense_: DataFrame, k: int = 20, alpha: float = 0.5, key: str = "doc_id") -> DataFrame:
    """``key``, score, dense, sparse: full outer join of both hit lists, only positive sparse scores."""
    s = sparse.where("score > 0").select(key, F.col("score").alias("sparse"))
    both = s.join(dense_.select(key, F.col("score").alias("dense")), key, "full_outer").na.fill(0.0, ["sparse", "dense"])
    return top(both.select(key, (alpha * F.col("dense") + (1 - alpha) * F.col("sparse")).alias("score"), "dense", "sparse"), k, key)


def hybrid(docs: DataFrame, query: str, k: int = 20, alpha: float = 0.5, key: str = "doc_id") -> DataFrame:
    """Hybrid search of ``docs`` with digest embeddings on the dense side."""
    vectors = docs.select(key, X.digest_embedding(F.coalesce("text", F.lit(""))).alias("v"))
    return fuse(top(bm25(docs, query, key), k, key), top(dense(vectors, X.digest_vector(query), key, "v"), k, key), k, alpha, key)


def payload_hits(hits: DataFrame, payloads: DataFrame, key: str) -> DataFrame:
    """Hits with their payload columns; a missing payload is null."""
    return hits.join(payloads, key, "left")


def grouped_bm25(chunks: DataFrame, queries: list[str], group: str = "doc_id") -> DataFrame:
    """``chunks`` with sparse: the scores of the queries, a handful, in turn; each group is a corpus of its own.

    The queries' words are counted in place; numbers, lengths and frequencies of a group are windows
    over one shuffle, so no word of a chunk becomes a row.
    """
    each = [Counter(q.lower().split()) for q in queries]
    wanted = list(dict.fromkeys(w for q in each for w in q))
    w = Window.partitionBy(group)
    rows = chunks.withColumn("d", X.let(X.tokens("text"), lambda t: query_words(t, wanted)))
    rows = rows.withColumn("tf", F.array(*[times_found(i) for i in range(len(wanted))]))
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("total", F.sum("d.dl").over(w)).withColumn("df", F.array(*[F.count_if(F.get("tf", F.lit(i)) > 0).over(w) for i in range(len(wanted))]))
    avgdl = F.when(F.col("total") == 0, 1.0).otherwise(F.col("total").cast("double")) / F.col("n")

    def part(word: str) -> Column:
        f, df = (F.get(c, F.lit(wanted.index(word))) for c in ("tf", "df"))
        return F.when(f > 0, idf(F.col("n"), df) * (f * (K1 + 1) / (f + K1 * (1 - B + B * (F.col("d.dl") / avgdl))))).otherwise(0.0)

    scores = [sum((times * part(word) for word, times in q.items()), F.lit(0.0)) for q in each]
    return rows.withColumn("sparse", F.array(*scores)).drop("d", "tf", "n", "total", "df")


def rank_by(scored: DataFrame, group: list[str], k: int | Column, order: list[Column]) -> DataFrame:
    """The first k rows of each group, numbered in ``rank``."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def index_tables(spark: SparkSession, chunks: DataFrame, path: str, key: str = "chunk_id") -> None:
    """Writes postings, lengths and hashed embeddings under ``path``; a second run overwrites the first."""
    postings(chunks, key).write.mode("overwrite").parquet(f"{path}/postings")
    chunks.select(key, F.size(X.tokens("text")).alias("length"), X.hash_embedding("text").alias("embedding")).write.mode("overwrite").parquet(f"{path}/chunks")
