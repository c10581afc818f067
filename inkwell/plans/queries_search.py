"""Retrieval and pass queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as X
from ..operators import chunk, passes, search
from . import tables as T
from .queries_text import CHUNKS, STRIP, WORDS

QUERY = "The of and house the ou eau para der"
WORD = r"list_filter(string_split_regex(lower({}), '\s+'), lambda w: w <> '')"


def bm25_topk(spark, d):
    top = search.top(search.bm25(T.documents(spark, d), QUERY), 20)
    return top.select("doc_id", F.round("score", 6).alias("score"))


def term_df(spark, d):
    return search.term_df(T.documents(spark, d))


def postings(spark, d):
    return search.postings(T.documents(spark, d))


def corpus_stats(spark, d):
    return search.corpus_stats(T.documents(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


def _vector(e, vec_id):
    """The query vector, one row, as a literal."""
    row = e.where(F.col("vec_id") == vec_id).select("embedding").first()
    return F.array(*[F.lit(float(x)) for x in row.embedding])


def dense_topk(spark, d):
    e = T.table(spark, d, "embeddings").select("vec_id", "embedding")
    query = _vector(e, 0)
    return search.top(search.dense(e, query), 20, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def payload_topk(spark, d):
    e = T.table(spark, d, "embeddings")
    query = _vector(e, 7)
    hits = search.top(search.dense(e, query), 10, "vec_id")
    return search.payload_hits(hits, e.where("label <> 3").select("vec_id", "label"), "vec_id").select("vec_id", F.round("score", 6).alias("score"), "label")


def hybrid_topk(spark, d):
    h = search.hybrid(T.documents(spark, d), QUERY)
    return h.select("doc_id", *[F.round(c, 6).alias(c) for c in ("score", "dense", "sparse")])


def sha_embedding(spark, d):
    e = T.documents(spark, d).select("doc_id", F.posexplode(X.digest_embedding(F.coalesce("text", F.lit("")))).alias("i", "x"))
    return e.select("doc_id", "i", F.round("x", 6).alias("x"))


def hash_embedding(spark, d):
    e = T.documents(spark, d).select("doc_id", X.hash_embedding("text").alias("v"))
    return e.select("doc_id", F.size("v").alias("dim"), F.round(X.dot(F.col("v"), F.col("v")), 6).alias("norm"))


def _passages(spark, d):
    p = T.table(spark, d, "documents")
    i = F.col("doc_id")
    path = F.when(i % 4 != 0, F.concat_ws("/", "source", F.when(i % 3 == 0, F.col("lang")), F.when(i % 5 == 0, F.lit("x"))))
    return p.select("doc_id", "text", F.when(i % 6 != 0, X.word_count("text")).alias("token_count"), (i % 5).alias("sentence_start"), (i % 5 + i % 7 - 1).alias("sentence_end"), path.alias("header_path"))


def flow_score(spark, d):
    return _passages(spark, d).select("doc_id", X.flow_score(F.col("token_count"), F.col("text"), F.col("sentence_start"), F.col("sentence_end")).alias("score"))


def energy_score(spark, d):
    return T.documents(spark, d).select("doc_id", X.energy_score(F.col("text")).alias("score"))


def graph_score(spark, d):
    return _passages(spark, d).select("doc_id", X.graph_score(F.col("header_path")).alias("score"))


def _chunks(spark, d):
    c = chunk.chunks(T.documents(spark, d))
    return c.select("doc_id", (F.col("chunk_no") - 1).alias("idx"), "chunk_id", "text", "token_count", "sentence_start", "sentence_end", F.lit(None).cast("string").alias("header_path"))


def pass_ranked(spark, d):
    r = passes.retrieve(spark, _chunks(spark, d))
    return r.select("doc_id", "domain", "idx", *[F.round(c, 4).alias(c) for c in ("dense_score", "sparse_score", "flow_score", "energy_score", "graph_score")], F.round("total_score", 3).alias("total_score"))


def pass_citations(spark, d):
    return passes.citations(passes.retrieve(spark, _chunks(spark, d)))


def pass_results(spark, d):
    r = passes.results(spark, passes.retrieve(spark, _chunks(spark, d)))
    return r.select("doc_id", "pass_id", "pass_name", F.size("citations").alias("n_citations"), F.size("retrieval").alias("n_hits"), "prompt_tokens", "completion_tokens", F.sha2("answer", 256).alias("answer_sha"))


def pass_manifest(spark, d):
    done = passes.per_domain(T.documents(spark, d).select("doc_id")).withColumnRenamed("domain", "pass_name")
    return passes.manifest(done).select("doc_id", F.explode("passes").alias("pass_name", "path"))


def _ranked_documents(spark, d):
    s = search.bm25(T.documents(spark, d), "the of").select("doc_id", "score")
    t = T.table(spark, d, "documents").join(s, "doc_id")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id"))
    return t.select(F.col("source").alias("domain"), F.lit(0).alias("doc_id"), rank.alias("rank"), F.concat("lang", (F.col("doc_id") % 40).cast("string")).alias("chunk_id"), "text", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("header_path"), F.col("doc_id").alias("row_id"))


def context_window(spark, d):
    return passes.window(_ranked_documents(spark, d), budget=2000).select("domain", "row_id", "tokens", "total")


def offline_completion(spark, d):
    c = T.documents(spark, d).select("doc_id", X.completion(F.lit(" Summarise. "), F.col("text"), 50).alias("answer"))
    return c


QUERIES = {f.__name__: f for f in (bm25_topk, term_df, postings, corpus_stats, dense_topk, payload_topk, hybrid_topk, sha_embedding, hash_embedding, flow_score, energy_score, graph_score, pass_ranked, pass_citations, pass_results, pass_manifest, context_window, offline_completion)}

BM25 = f"""q AS (SELECT w AS term, count(*) AS times FROM (SELECT unnest({WORD.format("'" + QUERY + "'")}) w) GROUP BY 1),
t AS (SELECT doc_id, {WORD.format("coalesce(text, '')")} AS t FROM documents),
st AS (SELECT count(*) n, sum(len(t)) / count(*) avgdl FROM t),
tf AS (SELECT doc_id, len(t) AS dl, q.term, times, len(list_filter(t, lambda w: w = q.term)) AS tf FROM t, q),
df AS (SELECT term, count(*) FILTER (WHERE tf > 0) df FROM tf GROUP BY 1),
bm AS (SELECT doc_id, sum(CASE WHEN tf > 0 THEN times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) ELSE 0 END) AS score FROM tf JOIN df USING (term), st GROUP BY 1)"""
EMBED = "list_transform(range(0, 16), lambda i: (strpos('0123456789abcdef', substr(h, CAST(2 * i + 1 AS INT), 1)) * 16 + strpos('0123456789abcdef', substr(h, CAST(2 * i + 2 AS INT), 1)) - 17) / 255.0::DOUBLE * cos(i + 1))"
COSINE = "(list_inner_product({0}, {1}) / (CASE WHEN list_inner_product({0}, {0}) = 0 THEN 1 ELSE sqrt(list_inner_product({0}, {0})) END * CASE WHEN list_inner_product({1}, {1}) = 0 THEN 1 ELSE sqrt(list_inner_product({1}, {1})) END))"
RANKED = rf"""{CHUNKS},
c AS (SELECT *, chunk_no - 1 AS idx, {WORD.format('text')} AS w FROM chunks),
dom AS (SELECT unnest(['mechanical', 'electrical', 'software', 'controls', 'project_mgmt']) AS domain),
st AS (SELECT doc_id, count(*) n, sum(len(w)) / count(*) avgdl FROM c GROUP BY 1),
qt AS (SELECT domain, unnest([domain, 'engineering', 'insights']) AS term FROM dom),
tf AS (SELECT doc_id, idx, len(w) dl, term, len(list_filter(w, lambda x: x = term)) tf FROM c, (SELECT DISTINCT term FROM qt)),
df AS (SELECT doc_id, term, count(*) df FROM tf WHERE tf > 0 GROUP BY 1, 2),
sp AS (SELECT tf.doc_id, domain, idx, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) score FROM tf JOIN qt USING (term) JOIN df ON df.doc_id = tf.doc_id AND df.term = tf.term JOIN st ON st.doc_id = tf.doc_id WHERE tf > 0 GROUP BY 1, 2, 3),
ev AS (SELECT doc_id, idx, {EMBED} v FROM (SELECT *, sha256(text) h FROM c)), eq AS (SELECT domain, {EMBED} q FROM (SELECT domain, sha256(domain || ' engineering insights') h FROM dom)),
de AS (SELECT doc_id, domain, idx, {COSINE.format('v', 'q')} score FROM ev, eq),
s12 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, domain ORDER BY score DESC, idx) r FROM sp) WHERE r <= 12),
d12 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, domain ORDER BY score DESC, idx) r FROM de) WHERE r <= 12),
fu AS (SELECT coalesce(s12.doc_id, d12.doc_id) doc_id, coalesce(s12.domain, d12.domain) domain, coalesce(s12.idx, d12.idx) idx, coalesce(d12.score, 0) dense_score, coalesce(s12.score, 0) sparse_score FROM s12 FULL JOIN d12 ON s12.doc_id = d12.doc_id AND s12.domain = d12.domain AND s12.idx = d12.idx),
f12 AS (SELECT * FROM (SELECT *, 0.5 * dense_score + 0.5 * sparse_score AS score, row_number() OVER (PARTITION BY doc_id, domain ORDER BY 0.5 * dense_score + 0.5 * sparse_score DESC, idx) fr FROM fu) WHERE fr <= 12),
sc AS (SELECT f12.*, text, token_count, sentence_start, sentence_end, doc_id || ':c' || (idx + 1) AS chunk_id, round(token_count * 0.05::DOUBLE + 1.0::DOUBLE / (sentence_end - sentence_start + 1), 4) flow_score, round(length(regexp_replace(text, '[^\p{{Nd}}\p{{Lu}}%°±]', '', 'g')) / length(text), 4) energy_score, 0.5::DOUBLE graph_score FROM f12 JOIN c USING (doc_id, idx)),
ra AS (SELECT *, score + 0.3 * flow_score + 0.2 * energy_score + 0.1 * graph_score AS total_score, row_number() OVER (PARTITION BY doc_id, domain ORDER BY score + 0.3 * flow_score + 0.2 * energy_score + 0.1 * graph_score DESC, fr) AS rank FROM sc)"""
PASSAGES = "p AS (SELECT doc_id, text, doc_id % 5 AS a, doc_id % 5 + doc_id % 7 - 1 AS b, CASE WHEN doc_id % 4 <> 0 THEN concat_ws('/', source, CASE WHEN doc_id % 3 = 0 THEN lang END, CASE WHEN doc_id % 5 = 0 THEN 'x' END) END AS path FROM documents)"

ORACLES = {
    "bm25_topk": f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 20",
    "term_df": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({WORD.format('text')}) AS term FROM documents) GROUP BY 1",
    "postings": f"SELECT doc_id, term, CAST(count(*) AS INT) AS tf FROM (SELECT doc_id, unnest({WORD.format('text')}) AS term FROM documents) GROUP BY 1, 2 HAVING count(*) > 1",
    "corpus_stats": f"SELECT count(*) AS n_docs, CAST(sum(len({WORD.format('text')})) AS BIGINT) AS total_tokens, round(sum(len({WORD.format('text')})) / count(*), 6) AS avgdl FROM documents",
    "dense_topk": f"WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) v FROM embeddings), s AS (SELECT e.vec_id, {COSINE.format('e.v', 'q.v')} AS score FROM e, (SELECT v FROM e WHERE vec_id = 0) q) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 20",
    "payload_topk": f"WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) v FROM embeddings), s AS (SELECT e.vec_id, label, {COSINE.format('e.v', 'q.v')} AS score FROM e, (SELECT v FROM e WHERE vec_id = 7) q) SELECT vec_id, round(score, 6) AS score, CASE WHEN label <> 3 THEN CAST(label AS BIGINT) END AS label FROM s ORDER BY s.score DESC, vec_id LIMIT 10",
    "hybrid_topk": f"""WITH {BM25}, sp AS (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 20), em AS (SELECT doc_id, {EMBED} v FROM (SELECT doc_id, sha256(coalesce(text, '')) h FROM documents)), qv AS (SELECT {EMBED} q FROM (SELECT sha256('{QUERY}') h)),
de AS (SELECT doc_id, {COSINE.format('v', 'q')} score FROM em, qv ORDER BY 2 DESC, 1 LIMIT 20), f AS (SELECT coalesce(sp.doc_id, de.doc_id) doc_id, coalesce(de.score, 0) dense, coalesce(sp.score, 0) sparse FROM (SELECT * FROM sp WHERE score > 0) sp FULL JOIN de ON sp.doc_id = de.doc_id)
SELECT doc_id, round(0.5 * dense + 0.5 * sparse, 6) AS score, round(dense, 6) AS dense, round(sparse, 6) AS sparse FROM f ORDER BY 0.5 * f.dense + 0.5 * f.sparse DESC, doc_id LIMIT 20""",
    "sha_embedding": f"WITH e AS (SELECT doc_id, {EMBED} v FROM (SELECT doc_id, sha256(coalesce(text, '')) h FROM documents)) SELECT doc_id, generate_subscripts(v, 1) - 1 AS i, round(unnest(v), 6) AS x FROM e",
    "hash_embedding": r"SELECT doc_id, CAST(16 AS BIGINT) AS dim, CASE WHEN regexp_matches(text, '[\p{L}\p{Nd}_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents",
    "flow_score": f"WITH {PASSAGES} SELECT doc_id, round(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) * 0.05::DOUBLE + 1.0::DOUBLE / greatest(b - a + 1, 1), 4) AS score FROM p",
    "energy_score": r"SELECT doc_id, CASE WHEN length(coalesce(text, '')) = 0 THEN 0.0 ELSE round(length(regexp_replace(text, '[^\p{Nd}\p{Lu}%°±]', '', 'g')) / length(text), 4) END::DOUBLE AS score FROM documents",
    "graph_score": f"WITH {PASSAGES} SELECT doc_id, CASE WHEN coalesce(path, '') = '' THEN 0.5 ELSE round(1.0::DOUBLE / len(string_split(path, '/')) + 0.05::DOUBLE * len(string_split(path, '/')), 4) END::DOUBLE AS score FROM p",
    "pass_ranked": f"WITH RECURSIVE {RANKED} SELECT doc_id, domain, idx, round(dense_score, 4) AS dense_score, round(sparse_score, 4) AS sparse_score, round(flow_score, 4) AS flow_score, round(energy_score, 4) AS energy_score, graph_score, round(total_score, 3) AS total_score FROM ra",
    "pass_citations": f"WITH RECURSIVE {RANKED} SELECT doc_id, domain, rank, chunk_id, CAST(NULL AS VARCHAR) AS header_path, sentence_start, sentence_end FROM ra WHERE rank <= 3 AND doc_id % 5 = 0",
    "pass_results": rf"""WITH RECURSIVE {RANKED}, u AS (SELECT doc_id, domain, rank, {STRIP.format('text')} AS body FROM ra WHERE {STRIP.format('text')} <> ''),
w AS (SELECT *, len({WORDS.format('body')}) AS tk, sum(len({WORDS.format('body')})) OVER (PARTITION BY doc_id, domain ORDER BY rank) AS total, row_number() OVER (PARTITION BY doc_id, domain ORDER BY rank) AS place FROM u),
x AS (SELECT doc_id, domain, string_agg(body, chr(10) || chr(10) ORDER BY rank) AS context FROM w WHERE place = 1 OR total <= 400 GROUP BY 1, 2), h AS (SELECT doc_id, domain, count(*) n FROM ra GROUP BY 1, 2),
pr AS (SELECT unnest([{', '.join(f"{{'domain': '{k}', 'usr': '{u}'}}" for k, (_, u) in passes.PROMPTS.items())}], recursive := true)),
y AS (SELECT doc_id, domain, n, context, list_filter(list_transform(string_split_regex(context, '\r\n|[\n\r\x0B\f]'), lambda s: {STRIP.format('s')}), lambda s: s <> '') AS l, {STRIP.format("usr || chr(10) || chr(10) || 'Context:' || chr(10) || context")} AS usr FROM x JOIN h USING (doc_id, domain) JOIN pr USING (domain)),
z AS (SELECT *, usr || chr(10) || chr(10) || 'Answer: ' || array_to_string({WORDS.format("array_to_string(l[1:5], ' ')")}[1:1024], ' ') AS answer FROM y)
SELECT doc_id, doc_id || ':' || replace(domain, '_', '-') AS pass_id, domain AS pass_name, CAST(least(n, 3) AS INT) AS n_citations, CAST(n AS INT) AS n_hits, CAST(len({WORDS.format('context')}) AS INT) AS prompt_tokens, CAST(len({WORDS.format('answer')}) AS INT) AS completion_tokens, sha256(answer) AS answer_sha FROM z""",
    "pass_manifest": "SELECT doc_id, p AS pass_name, 'artifacts/' || doc_id || '/passes/' || replace(p, '_', '-') || '.json' AS path FROM documents, (SELECT unnest(['mechanical', 'electrical', 'software', 'controls', 'project_mgmt']) AS p)",
    "context_window": rf"""WITH t AS (SELECT doc_id, source, lang, text, {WORD.format("coalesce(text, '')")} w FROM documents), st AS (SELECT count(*) n, sum(len(w)) / count(*) avgdl FROM t),
q AS (SELECT unnest(['the', 'of']) term), tf AS (SELECT doc_id, len(w) dl, term, len(list_filter(w, lambda x: x = term)) tf FROM t, q), df AS (SELECT term, count(*) FILTER (WHERE tf > 0) df FROM tf GROUP BY 1),
bm AS (SELECT doc_id, sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) ELSE 0 END) score FROM tf JOIN df USING (term), st GROUP BY 1),
r AS (SELECT source AS domain, doc_id AS row_id, lang || (doc_id % 40) AS chunk_id, text, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, doc_id) AS rank FROM t JOIN bm USING (doc_id)),
u AS (SELECT *, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS tokens, row_number() OVER (PARTITION BY domain, chunk_id ORDER BY rank) AS nth FROM r WHERE trim(text) <> ''),
c AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY domain ORDER BY rank) AS BIGINT) AS total, row_number() OVER (PARTITION BY domain ORDER BY rank) AS place FROM u WHERE nth = 1)
SELECT domain, row_id, tokens, total FROM c WHERE place = 1 OR total <= 2000""",
    "offline_completion": r"""WITH l0 AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0B\f]'), lambda s: trim(s)), lambda s: s <> '') a FROM documents)
SELECT doc_id, CASE WHEN len(a) = 0 THEN 'No relevant context provided.' ELSE 'Summarise.' || chr(10) || chr(10) || 'Answer: ' || array_to_string(list_filter(string_split_regex(array_to_string(a[1:5], ' '), '\s+'), lambda w: w <> '')[1:50], ' ') END AS answer FROM l0""",
}
