"""Text, ingest and enrichment queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as X
from ..operators import chunk, enrich, ingest
from . import tables as T

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"
SENTENCES = rf"""sraw AS (SELECT doc_id, string_split_regex(regexp_replace({STRIP.format('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|\n+') a FROM documents),
s1 AS (SELECT doc_id, {STRIP.format('unnest(a)')} x, generate_subscripts(a, 1) k FROM sraw),
s2 AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 i FROM s1 WHERE x <> ''),
s3 AS (SELECT *, len({WORDS.format('x')}) tok FROM s2),
s4 AS (SELECT *, (tok <= 6 AND x = upper(x) AND x <> lower(x)) OR (length(regexp_replace(x, '[^\p{{Lu}}]', '', 'g')) / length(x) > 0.55 AND tok <= 12) hd,
 sum(tok) OVER (PARTITION BY doc_id ORDER BY i) cum, count(*) OVER (PARTITION BY doc_id) n, avg(tok) OVER (PARTITION BY doc_id) av FROM s3)"""
CHUNKS = rf"""{SENTENCES},
e0 AS (SELECT a.doc_id, a.i, min(b.i) FILTER (WHERE b.i > a.i AND b.hd) hh, min(b.i + 1) FILTER (WHERE b.cum - a.cum + a.tok >= 90) bb FROM s4 a JOIN s4 b ON a.doc_id = b.doc_id AND b.i >= a.i GROUP BY 1, 2),
e AS (SELECT s4.doc_id, s4.i, s4.n, CAST(greatest(0, least(round_even(12 / greatest(s4.av, 1.0), 0), s4.n - 1)) AS INT) ov, least(s4.n, coalesce(hh, s4.n), coalesce(bb, s4.n)) en FROM s4 JOIN e0 USING (doc_id, i)),
ch AS (SELECT doc_id, i st, en, n, ov, CAST(1 AS BIGINT) AS chunk_no FROM e WHERE i = 0 UNION ALL SELECT e.doc_id, e.i, e.en, e.n, e.ov, ch.chunk_no + 1 FROM ch JOIN e ON e.doc_id = ch.doc_id AND e.i = greatest(ch.en - ch.ov, ch.st + 1) WHERE ch.en < ch.n),
chunks AS (SELECT ch.doc_id, ch.chunk_no, ch.st AS sentence_start, ch.en - 1 AS sentence_end, CAST(sum(s4.tok) AS INT) AS token_count, string_agg(s4.x, ' ' ORDER BY s4.i) AS text FROM ch JOIN s4 ON s4.doc_id = ch.doc_id AND s4.i >= ch.st AND s4.i < ch.en GROUP BY 1, 2, 3, 4)"""


def page_split(spark, d):
    p = ingest.pages(T.paged(spark, d))
    return p.select("doc_id", "page_number", "text", F.size("blocks").alias("n_blocks"), "n_images", "coverage")


def block_split(spark, d):
    return ingest.blocks(ingest.pages(T.paged(spark, d))).select("block_id", "doc_id", "page", "block_no", "text", F.col("font.size").alias("font_size"), "confidence")


def image_markers(spark, d):
    return ingest.images(T.paged(spark, d))


def doc_stats(spark, d):
    s = ingest.doc_stats(ingest.pages(T.paged(spark, d)))
    return s.select("doc_id", "page_count", "block_count", "images", F.round("avg_coverage", 6).alias("avg_coverage"))


def ocr_fallback(spark, d):
    p = ingest.ocr_fallback(ingest.pages(T.paged(spark, d)))
    return p.select("doc_id", "page_number", F.size("blocks").alias("n_blocks"), "coverage", "ocr", ingest.recovered_confidence(F.lit(0.5), F.col("ocr")).alias("confidence"))


def table_rows(spark, d):
    p = ingest.pages(T.documents(spark, d))
    return enrich.table_rows(p).select("doc_id", "page_number", "row_no", F.posexplode("cells").alias("i", "cell")).withColumn("cell_no", F.col("i") + 1).drop("i")


def tables_per_page(spark, d):
    return enrich.tables(enrich.table_rows(ingest.pages(T.documents(spark, d)))).select("doc_id", "table_id", "page", F.size("rows").alias("n_rows"))


def links(spark, d):
    p = T.table(spark, d, "pages").select("page_id", F.concat(F.lit("at "), "url", F.lit(" and <"), "url", F.lit("> "), "html").alias("text"))
    return enrich.links(p, ["page_id"])


def list_items(spark, d):
    turns = T.table(spark, d, "conversations")
    line = F.concat(F.when(F.col("role") == "user", F.concat((F.col("turn") + 1).cast("string"), F.lit(". "))).otherwise(F.lit("- ")), F.col("text"))
    blocks = turns.groupBy(F.col("conv_id").alias("block_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return enrich.list_items(blocks)


def block_semantics(spark, d):
    docs = T.paged(spark, d)
    pages = ingest.pages(docs)
    tables = enrich.table_rows(pages).select("doc_id", F.col("page_number").alias("page"))
    return enrich.semantics(ingest.blocks(pages), tables, ingest.images(docs).select("doc_id", "page")).select("block_id", "role", "confidence")


def reading_order(spark, d):
    e = T.table(spark, d, "events")
    w = F.floor(F.col("value") / 50)
    b = e.select(F.col("user_id").alias("doc_id"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("block_id"), F.col("event_id").alias("index"), (F.col("event_id") % 3).alias("page"), F.array((F.col("event_id") % 5).cast("double"), w.cast("double")).alias("bbox"))
    return enrich.reading_order(b).select("doc_id", "position", "index")


def parse_summary(spark, d):
    docs = T.paged(spark, d)
    pages = ingest.pages(docs)
    out = enrich.parse_summary(pages, ingest.blocks(pages), enrich.tables(enrich.table_rows(pages)), enrich.links(pages, ["doc_id", "page_number"]), ingest.images(docs))
    return out.drop("confidence")


def language_heuristic(spark, d):
    x = X.language("text")
    return T.documents(spark, d).select("doc_id", x["code"].alias("code"), x["confidence"].alias("confidence"), x["method"].alias("method"))


def sentence_split(spark, d):
    return chunk.sentences(T.documents(spark, d)).select("doc_id", "sentence_no", "sentence")


def sentence_tokens(spark, d):
    s = chunk.sentences(T.documents(spark, d))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum("tokens").alias("n_tokens"), F.max("tokens").alias("longest"))


def heading_sentences(spark, d):
    return chunk.sentences(T.documents(spark, d)).where("heading").select("doc_id", "sentence_no", "tokens")


def uf_chunks(spark, d):
    return chunk.chunks(T.documents(spark, d)).select("doc_id", "chunk_no", "sentence_start", "sentence_end", "token_count", F.sha2("text", 256).alias("text_sha"))


def _fonts(spark, d):
    b = ingest.blocks(ingest.pages(T.paged(spark, d)))
    size = F.col("doc_id") % 9 + F.col("block_no") % 5 + 6.0
    weight = F.when(F.col("block_no") % 4 == 0, "Bold").otherwise("normal")
    return b.withColumn("font", F.struct(F.lit("SourceSans").alias("family"), size.alias("size"), weight.alias("weight"), F.lit("normal").alias("style")))


def typography_doc(spark, d):
    _, per_doc = enrich.typography(_fonts(spark, d))
    return per_doc.select("doc_id", F.round("avg_size", 6).alias("avg_size"), F.round("avg_weight", 6).alias("avg_weight"), F.size("headings").alias("n_headings"))


def typography_page(spark, d):
    per_page, _ = enrich.typography(_fonts(spark, d))
    return per_page.select("doc_id", "page", F.round("avg_size", 6).alias("avg_size"), "max_size", "min_size")


def upload_validation(spark, d):
    o = T.table(spark, d, "orders")
    k = F.col("o_orderkey")
    name = F.when(k % 11 == 0, "../a.pdf").when(k % 11 == 1, "http://x/a.pdf").when(k % 11 == 2, "  ").when(k % 11 == 3, "a.exe").when(k % 11 == 4, "dir.v2/a").when(k % 11 == 5, "A.PDF").when(k % 11 == 6, "notes.txt").when(k % 11 < 10, F.concat(k.cast("string"), F.lit(".pdf")))
    file_id = F.when(k % 13 == 0, "a b").when(k % 13 == 1, "").when(k % 13 == 2, " ").when(k % 13 < 6, F.concat(F.lit("f"), k.cast("string")))
    u = o.select(k.alias("upload_id"), file_id.alias("file_id"), name.alias("file_name"), F.when(k % 7 == 0, "b.doc").when(k % 7 == 1, "noext").alias("upload_filename"), F.when(k % 17 != 0, F.col("o_custkey") * 100000).alias("size_bytes"), (k % 5 == 0).alias("is_direct"))
    tenth = F.col("upload_id") % 10 == 0
    u = u.withColumns({c: F.when(~tenth, F.col(c)) for c in ("file_id", "file_name")})
    return ingest.validate(u).select("upload_id", F.coalesce("error", F.lit("ok")).alias("outcome"))


def filename_slug(spark, d):
    return T.titles(spark, d).select("doc_id", X.file_slug(F.concat(F.lit(" ..Ｐｌａｎ①ﬁ e\u0301"), "text", F.lit(".v2/plan (1).pdf"))).alias("slug"), X.slug("text").alias("id_slug"))


def double_extension(spark, d):
    e = F.when(F.col("o_orderkey") % 4 == 0, ".exe.pdf").when(F.col("o_orderkey") % 4 == 1, ".PDF").when(F.col("o_orderkey") % 4 == 2, ".txt.pdf").otherwise(".com")
    o = T.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), e).alias("name"))
    return o.select("o_orderkey", X.double_extension("name", (".pdf", ".txt")).alias("rejected"))


def mime_sniff(spark, d):
    c = T.documents(spark, d).select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "%PDF-1.7 ").otherwise("PDF "), "text").cast("binary").alias("content"))
    return c.select("doc_id", F.coalesce(X.mime("content"), F.lit("rejected")).alias("mime"))


def checksum_dedupe(spark, d):
    return ingest.dedupe_uploads(ingest.checksums(T.documents(spark, d), "text").drop("text"))


def artifact_checksum(spark, d):
    return ingest.checksums(T.documents(spark, d), "text").drop("text")


def latest_upsert(spark, d):
    e = T.table(spark, d, "events")
    return ingest.upsert(e.select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


def unmanaged_antijoin(spark, d):
    path = F.concat(F.lit("store/"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ".txt").otherwise(".PDF")).alias("path")
    o = T.table(spark, d, "orders")
    return ingest.unmanaged(o.select(path), o.where("o_orderstatus <> 'F'").select(path))


def unseen_uploads(spark, d):
    docs = ingest.checksums(T.documents(spark, d), "text").drop("text")
    return ingest.unseen(docs, docs.where("doc_id % 2 = 0")).select("doc_id", "sha256")


def audit_rollup(spark, d):
    e = T.table(spark, d, "events")
    agg = e.groupBy("event_type").agg(F.count("*").alias("runs"), F.count_if(F.col("value") < 1).alias("failed"), F.round(F.sum("value"), 2).alias("total"), F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"))
    return agg.withColumns({c: F.round(c, 6) for c in ("p50", "p95")})


def nearest_rank(spark, d):
    """Sorted values at round((n - 1) q), half to even, per event type; the rank is a window over one type's rows."""
    e = T.table(spark, d, "events")
    w = Window.partitionBy("event_type")
    r = e.select("event_type", "value", (F.row_number().over(w.orderBy("value")) - 1).alias("r"), F.count("*").over(w).alias("n"))
    picks = [F.max(F.when(F.col("r") == F.bround((F.col("n") - 1) * q, 0).cast("long"), F.col("value"))).alias(c) for c, q in (("p50", 0.5), ("p95", 0.95))]
    return r.groupBy("event_type").agg(*picks)


def secret_masking(spark, d):
    c = T.table(spark, d, "customer")
    return c.select("c_custkey", X.mask("c_name").alias("masked"), X.mask("c_mktsegment").alias("segment"), X.mask_header(F.concat(F.lit("Bearer "), "c_name")).alias("header"))


QUERIES = {f.__name__: f for f in (page_split, block_split, image_markers, doc_stats, ocr_fallback, table_rows, tables_per_page, list_items, block_semantics, reading_order, parse_summary, language_heuristic, sentence_split, sentence_tokens, heading_sentences, uf_chunks, typography_doc, typography_page, upload_validation, filename_slug, double_extension, mime_sniff, checksum_dedupe, artifact_checksum, latest_upsert, unmanaged_antijoin, unseen_uploads, audit_rollup, nearest_rank, secret_masking)} | {"links_html": links}

IMG = r"(?i)\[image:([^\]]+)\]"
URL = r"https?://[\p{L}\p{N}_\-.~:/?#\[\]@!$&''()*+,;=%]+"
TROWS = rf"""tl0 AS (SELECT doc_id, page_number, string_split_regex(array_to_string(blocks, chr(10)), '\r\n|[\n\r\x0B\f]') a FROM pg),
tl AS (SELECT doc_id, page_number, unnest(a) line, generate_subscripts(a, 1) i FROM tl0),
tc AS (SELECT doc_id, page_number, i, list_filter(list_transform(string_split_regex(line, '[\t|]'), lambda c: {STRIP.format('c')}), lambda c: c <> '') cells FROM tl WHERE regexp_matches(line, '[\t|]')),
tr AS (SELECT doc_id, page_number, cells, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY i) row_no FROM tc WHERE len(cells) > 0)"""
PLAIN = T.PAGED.split("\nseg0", 1)
PLAIN = "raw AS (SELECT doc_id, text FROM documents),\nseg0" + PLAIN[1]
BLOCKS = "bl AS (SELECT doc_id, page_number AS page, unnest(blocks) AS text, generate_subscripts(blocks, 1) AS block_no FROM pg)"
FONTS = f"{T.PAGED},\n{BLOCKS},\nft AS (SELECT *, doc_id % 9 + block_no % 5 + 6.0::DOUBLE AS size, CASE WHEN block_no % 4 = 0 THEN 'Bold' ELSE 'normal' END AS weight FROM bl)"

ORACLES = {
    "page_split": f"WITH {T.PAGED} SELECT doc_id, page_number, array_to_string(blocks, chr(10)) AS text, len(blocks) AS n_blocks, n_images, CASE WHEN len(blocks) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS coverage FROM pg",
    "block_split": f"WITH {T.PAGED}, {BLOCKS} SELECT doc_id || ':p' || page || ':b' || block_no AS block_id, doc_id, page, block_no, text, 12.0::DOUBLE AS font_size, 0.5::DOUBLE AS confidence FROM bl",
    "image_markers": f"WITH {T.PAGED}, im AS (SELECT doc_id, page_number, unnest(a) AS name, generate_subscripts(a, 1) AS k FROM (SELECT doc_id, page_number, regexp_extract_all(segment, '{IMG}', 1) a FROM pg0)) SELECT doc_id, page_number AS page, doc_id || ':p' || page_number || ':img' || k AS image_id, {STRIP.format('name')} AS description FROM im",
    "doc_stats": f"WITH {T.PAGED} SELECT doc_id, count(*) AS page_count, CAST(sum(len(blocks)) AS BIGINT) AS block_count, CAST(sum(n_images) AS BIGINT) AS images, round(avg(CASE WHEN len(blocks) > 0 THEN 1.0 ELSE 0.0 END), 6) AS avg_coverage FROM pg GROUP BY 1",
    "ocr_fallback": f"WITH {T.PAGED}, c AS (SELECT *, CASE WHEN len(blocks) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE cov FROM pg), m AS (SELECT *, avg(cov) OVER (PARTITION BY doc_id) < 0.85 AND cov < 0.85 AS ocr FROM c) SELECT doc_id, page_number, CASE WHEN ocr THEN greatest(len(blocks), 1) ELSE len(blocks) END AS n_blocks, CASE WHEN ocr THEN 1.0 ELSE cov END::DOUBLE AS coverage, ocr, CASE WHEN ocr THEN 0.72 ELSE 0.5 END::DOUBLE AS confidence FROM m",
    "table_rows": f"WITH {PLAIN}, {TROWS} SELECT doc_id, page_number, row_no, unnest(cells) AS cell, generate_subscripts(cells, 1) AS cell_no FROM tr",
    "tables_per_page": f"WITH {PLAIN}, {TROWS}, t AS (SELECT doc_id, page_number, count(*) n_rows FROM tr GROUP BY 1, 2) SELECT doc_id, doc_id || ':p' || page_number || ':tbl' || row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS table_id, page_number AS page, n_rows FROM t",
    "links_html": f"WITH t AS (SELECT page_id, 'at ' || url || ' and <' || url || '> ' || html AS text FROM pages), m AS (SELECT page_id, regexp_extract_all(text, '{URL}') u, string_split_regex(text, '{URL}') g FROM t), x AS (SELECT page_id, u, g, unnest(range(1, len(u) + 1)) AS k FROM m) SELECT page_id, k AS link_no, u[k] AS url, CAST(list_sum(list_transform(g[1:k], lambda s: length(s))) + coalesce(list_sum(list_transform(u[1:k-1], lambda s: length(s))), 0) AS BIGINT) AS start, CAST(list_sum(list_transform(g[1:k], lambda s: length(s))) + list_sum(list_transform(u[1:k], lambda s: length(s))) AS BIGINT) AS \"end\" FROM x",
    "list_items": rf"""WITH b AS (SELECT conv_id AS block_id, string_agg(CASE WHEN role = 'user' THEN (turn + 1) || '. ' ELSE '- ' END || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1),
l0 AS (SELECT block_id, string_split_regex(text, '\r\n|[\n\r\x0B\f]') a FROM b), l AS (SELECT block_id, {STRIP.format('unnest(a)')} line, generate_subscripts(a, 1) i FROM l0),
m AS (SELECT block_id, i, regexp_extract(line, '^(\d+\.|[\-*])\s+(.+)', 1) prefix, regexp_extract(line, '^(\d+\.|[\-*])\s+(.+)', 2) body FROM l WHERE regexp_matches(line, '^(\d+\.|[\-*])\s+.+'))
SELECT block_id, bool_and(prefix LIKE '%.') OVER (PARTITION BY block_id) AS ordered, row_number() OVER (PARTITION BY block_id ORDER BY i) AS item_no, prefix, body FROM m""",
    "block_semantics": f"""WITH {T.PAGED}, {BLOCKS}, {TROWS}, tp AS (SELECT DISTINCT doc_id, page_number AS page FROM tr), ip AS (SELECT doc_id, page_number AS page FROM pg WHERE n_images > 0),
j AS (SELECT bl.*, tp.page IS NOT NULL AS ht, ip.page IS NOT NULL AS hi, {STRIP.format('bl.text')} AS s FROM bl LEFT JOIN tp ON tp.doc_id = bl.doc_id AND tp.page = bl.page LEFT JOIN ip ON ip.doc_id = bl.doc_id AND ip.page = bl.page),
r AS (SELECT *, CASE WHEN s = '' THEN 'empty' WHEN s = upper(s) AND s <> lower(s) AND length(s) < 80 THEN 'heading' WHEN s LIKE '%:' THEN 'heading2' WHEN s LIKE '-%' OR s LIKE '*%' THEN 'list_item' WHEN ht THEN 'table_context' WHEN hi AND length(s) < 120 THEN 'caption' ELSE 'paragraph' END AS k FROM j)
SELECT doc_id || ':p' || page || ':b' || block_no AS block_id, replace(k, '2', '') AS role, CAST(CASE k WHEN 'empty' THEN 0.2 WHEN 'heading' THEN 0.85 WHEN 'heading2' THEN 0.7 WHEN 'list_item' THEN 0.75 WHEN 'table_context' THEN 0.55 WHEN 'caption' THEN 0.65 ELSE 0.6 END AS DOUBLE) AS confidence FROM r""",
    "reading_order": "SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, floor(value / 50), event_id % 5, 'b' || event_id) - 1 AS position, event_id AS \"index\" FROM events",
    "parse_summary": rf"""WITH {T.PAGED}, {TROWS}, base AS (SELECT doc_id, CAST(sum(len(blocks)) AS BIGINT) blocks, CAST(sum(n_images) AS BIGINT) images, string_agg(array_to_string(blocks, chr(10)), ' ' ORDER BY page_number) t FROM pg GROUP BY 1),
tt AS (SELECT doc_id, count(DISTINCT page_number) n FROM tr GROUP BY 1), ll AS (SELECT doc_id, CAST(sum(len(regexp_extract_all(array_to_string(blocks, chr(10)), '{URL}'))) AS BIGINT) n FROM pg GROUP BY 1)
SELECT base.doc_id, blocks, coalesce(tt.n, 0) AS tables, ll.n AS links, images, CASE WHEN {STRIP.format('t')} = '' THEN 'und' WHEN length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) / length(t) < 0.5 AND length(regexp_replace(t, '[^a-zA-Z]', '', 'g')) / length(t) < 0.3 THEN 'und' ELSE 'en' END AS language FROM base LEFT JOIN tt USING (doc_id) JOIN ll USING (doc_id)""",
    "language_heuristic": rf"""WITH r AS (SELECT doc_id, {STRIP.format('text')} = '' AS blank, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / greatest(length(text), 1) a, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / greatest(length(text), 1) l, length(regexp_replace(lower(text), '[^aeiou]', '', 'g')) / greatest(length(text), 1) v FROM documents)
SELECT doc_id, CASE WHEN blank OR (a < 0.5 AND l < 0.3) THEN 'und' ELSE 'en' END AS code, CASE WHEN blank THEN 0.0 WHEN a < 0.5 AND l < 0.3 THEN 0.35 ELSE round(least(1.0::DOUBLE, a * 0.4::DOUBLE + l * 0.4::DOUBLE + v * 0.2::DOUBLE), 3) END::DOUBLE AS confidence, CASE WHEN blank THEN 'empty' ELSE 'heuristic' END AS method FROM r""",
    "sentence_split": f"WITH {SENTENCES} SELECT doc_id, i AS sentence_no, x AS sentence FROM s2",
    "sentence_tokens": f"WITH {SENTENCES} SELECT doc_id, count(*) AS n_sentences, CAST(sum(tok) AS BIGINT) AS n_tokens, max(tok) AS longest FROM s3 GROUP BY 1",
    "heading_sentences": f"WITH {SENTENCES} SELECT doc_id, i AS sentence_no, tok AS tokens FROM s4 WHERE hd",
    "uf_chunks": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_no, sentence_start, sentence_end, token_count, sha256(text) AS text_sha FROM chunks",
    "typography_doc": rf"WITH {FONTS} SELECT doc_id, round(avg(size), 6) AS avg_size, round(avg(CASE WHEN weight = 'Bold' THEN 700.0 ELSE 400.0 END), 6) AS avg_weight, count(*) FILTER (WHERE text <> '' AND (size >= 16 OR (length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) / length(text) > 0.55 AND weight = 'Bold'))) AS n_headings FROM ft GROUP BY 1",
    "typography_page": f"WITH {FONTS} SELECT doc_id, page, round(avg(size), 6) AS avg_size, max(size) AS max_size, min(size) AS min_size FROM ft GROUP BY 1, 2",
    "upload_validation": r"""WITH u AS (SELECT o_orderkey AS k, o_orderkey % 5 = 0 AS direct, CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey * 100000 END AS size,
CASE o_orderkey % 7 WHEN 0 THEN 'b.doc' WHEN 1 THEN 'noext' END AS up,
CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'a b' WHEN o_orderkey % 13 = 1 THEN '' WHEN o_orderkey % 13 = 2 THEN ' ' WHEN o_orderkey % 13 < 6 THEN 'f' || o_orderkey END AS fid,
CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CASE o_orderkey % 11 WHEN 0 THEN '../a.pdf' WHEN 1 THEN 'http://x/a.pdf' WHEN 2 THEN '  ' WHEN 3 THEN 'a.exe' WHEN 4 THEN 'dir.v2/a' WHEN 5 THEN 'A.PDF' WHEN 6 THEN 'notes.txt' WHEN 10 THEN NULL ELSE o_orderkey || '.pdf' END END AS name FROM orders)
SELECT k AS upload_id, CASE
WHEN direct AND (coalesce(fid, '') <> '' OR coalesce(name, '') <> '') THEN 'direct_with_handle' WHEN direct AND coalesce(size, 0) = 0 THEN 'empty' WHEN direct AND size > 52428800 THEN 'too_large'
WHEN direct AND up = 'b.doc' THEN 'unsupported_extension' WHEN direct THEN 'ok'
WHEN coalesce(fid, '') = '' AND coalesce(name, '') = '' THEN 'no_handle' WHEN fid IS NOT NULL AND trim(fid) = '' THEN 'blank_file_id' WHEN trim(fid) LIKE '% %' THEN 'space_in_file_id' WHEN name IS NULL THEN 'ok'
WHEN trim(name) = '' THEN 'blank_file_name' WHEN name LIKE '%//%' THEN 'remote' WHEN name = '../a.pdf' THEN 'traversal' WHEN size IS NULL THEN 'missing'
WHEN NOT (lower(name) LIKE '%.pdf' OR lower(name) LIKE '%.txt') THEN 'unsupported_extension' WHEN size > 52428800 THEN 'too_large' ELSE 'ok' END AS outcome FROM u""",
    "filename_slug": rf"WITH {T.TITLES} SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(' ..Plan1fi é' || text || '.v2/plan (1).pdf', '[^A-Za-z0-9._-]+', '-', 'g'), '-+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS slug, lower(regexp_replace(regexp_replace(text, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS id_slug FROM titles",
    "double_extension": "SELECT o_orderkey, o_orderkey % 4 IN (0, 2) AS rejected FROM orders",
    "mime_sniff": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'application/pdf' ELSE 'rejected' END AS mime FROM documents",
    "checksum_dedupe": "WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents), o AS (SELECT *, min(doc_id) OVER (PARTITION BY sha256) AS owner FROM h) SELECT doc_id, sha256, CASE WHEN doc_id = owner THEN 'new' ELSE 'duplicate' END AS status, owner FROM o",
    "artifact_checksum": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes FROM documents",
    "latest_upsert": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1",
    "unmanaged_antijoin": "SELECT 'store/' || o_orderkey || '.PDF' AS path FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus = 'F'",
    "unseen_uploads": "WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents) SELECT doc_id, sha256 FROM h WHERE sha256 NOT IN (SELECT sha256 FROM h WHERE doc_id % 2 = 0)",
    "audit_rollup": "SELECT event_type, count(*) AS runs, count(*) FILTER (WHERE value < 1) AS failed, round(sum(value), 2) AS total, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
    "nearest_rank": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (WHERE r = CAST(round_even((n - 1) * 0.5, 0) AS BIGINT)) AS p50, max(value) FILTER (WHERE r = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT)) AS p95 FROM r GROUP BY 1",
    "secret_masking": "SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN repeat('*', length(c_name)) ELSE left(c_name, 4) || '...' || right(c_name, 4) END AS masked, CASE WHEN length(c_mktsegment) <= 8 THEN repeat('*', length(c_mktsegment)) ELSE left(c_mktsegment, 4) || '...' || right(c_mktsegment, 4) END AS segment, 'Bearer ' || CASE WHEN length(c_name) <= 8 THEN repeat('*', length(c_name)) ELSE left(c_name, 4) || '...' || right(c_name, 4) END AS header FROM customer",
}
