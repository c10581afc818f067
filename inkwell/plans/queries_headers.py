"""Header, section and tree queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunk, headers, ingest, sections, tree
from . import tables as T


def header_candidates(spark, d):
    c = chunk.chunks(T.documents(spark, d)).withColumn("chunk_index", F.col("chunk_no") - 1)
    return headers.candidates(c).select("doc_id", "chunk_id", "chunk_index", "text", "score", "section_key", "ordinal", "level", "sentence_start")


def header_base_score(spark, d):
    return T.titles(spark, d).select("doc_id", "text", F.round(headers.base_score("text"), 6).alias("score"))


def header_series_key(spark, d):
    k = headers.series_key("text")
    return T.titles(spark, d).select("doc_id", k["key"].alias("section_key"), k["ordinal"].alias("ordinal"), k["level"].alias("level"))


def header_viable(spark, d):
    o = T.table(spark, d, "orders")
    unit = F.get(F.array(*map(F.lit, ("mm", "psi", "%", "bolts", "RPM", "v", "of", "kg"))), F.col("o_custkey") % 8)
    text = F.concat((F.col("o_orderkey") % 100).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ".5 ").when(F.col("o_orderkey") % 3 == 1, " ").otherwise(""), unit)
    return o.select("o_orderkey", headers.viable(text).alias("viable"))


def header_trim(spark, d):
    return T.titles(spark, d).select("doc_id", headers.trim_header(F.concat(F.lit(" - "), "text", F.lit(" – and more words here"))).alias("trimmed"))


def header_typo_boost(spark, d):
    s = T.series(spark, d)
    score, boost = headers.typography_boost(F.col("score"), (F.col("chunk_index") % 9 + 10).cast("double"), F.when(F.col("chunk_index") % 2 == 0, 700.0).otherwise(400.0))
    return s.select("chunk_id", F.round(score, 6).alias("score"), F.round(boost, 6).alias("boost"))


def header_stitch(spark, d):
    s = T.series(spark, d)
    s = s.withColumn("section_key", F.when(F.col("chunk_index") % 7 < 4, "A").otherwise("B")).withColumn("ordinal", F.floor(F.col("chunk_index") / 14)).withColumn("doc_id", F.floor(F.col("chunk_index") / 50))
    st = headers.stitch(s)
    return st.select("doc_id", "chunk_index", "section_key", "ordinal", "text", "score", "sentence_start", "sentence_end", F.size("chunk_ids").alias("n_chunks"))


def header_dedupe(spark, d):
    return headers.dedupe(T.series(spark, d)).select("doc_id", "section_key", "ordinal", "chunk_index", "score")


def sequence_repair(spark, d):
    return headers.repair(T.series(spark, d)).select("doc_id", "chunk_id", "section_key", "ordinal", "score", "recovered")


def _headers(spark, d):
    s = T.series(spark, d)
    return headers.number(s).withColumn("chunk_ids", F.when(F.col("chunk_index") % 4 == 0, F.array("chunk_id", "chunk_id")).otherwise(F.array("chunk_id"))).withColumn("recovered", F.col("chunk_index") % 5 == 0)


def _chunks(spark, d):
    e = T.table(spark, d, "events")
    return e.select(F.col("user_id").alias("doc_id"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("chunk_id"), (F.col("event_id") * 3 + F.col("event_id") % 4 - 1).alias("sentence_start"), F.concat(F.lit(" "), "event_type").alias("text"))


def section_assign(spark, d):
    return sections.assign(_headers(spark, d), _chunks(spark, d))


def _sections(spark, d):
    h, c = _headers(spark, d), _chunks(spark, d)
    return sections.sections(h, c, sections.assign(h, c))


def section_text(spark, d):
    return _sections(spark, d).select("doc_id", "section_id", "header_id", F.size("chunk_ids").alias("n_chunks"), F.sha2("text", 256).alias("text_sha"), "level")


def section_map(spark, d):
    return sections.section_map(_sections(spark, d))


def header_tree(spark, d):
    return tree.nodes(_headers(spark, d)).select("doc_id", "node_id", "parent_id", "level")


def header_components(spark, d):
    n = tree.nodes(_headers(spark, d).drop("text").join(T.titles(spark, d).withColumnsRenamed({"doc_id": "k"}), F.col("chunk_index") == F.col("k")))
    return n.select("node_id", "text", *[F.round(c, 3).alias(c) for c in ("regex", "style", "entropy", "graph", "fluid", "llm_vote", "total")], F.coalesce("schema", F.lit("none")).alias("schema"), "decision", "joined")


def header_decision(spark, d):
    s = T.series(spark, d)
    return s.select("chunk_id", tree.decision(F.col("score")).alias("decision"))


def gap_report(spark, d):
    g = tree.gaps(tree.nodes(_headers(spark, d)))
    return g.select("doc_id", "n", "expected", "schema", F.coalesce("left", F.lit("-")).alias("left"), F.coalesce("right", F.lit("-")).alias("right"), "style_sim", "graph_adj", "confidence")


def gap_summary(spark, d):
    return tree.gap_report(tree.nodes(_headers(spark, d).withColumn("text", F.when(F.col("chunk_index") % 3 == 0, F.concat(F.lit("Appendix "), "text")).when(F.col("chunk_index") % 3 == 1, F.concat(F.lit("4 "), "text")).otherwise(F.concat(F.lit("B4 "), "text"))))).select("doc_id", F.array_join("schemas", ",").alias("schemas"), "holes")


def label_validation(spark, d):
    o, k = T.table(spark, d, "orders"), F.col("o_orderkey")
    name = F.when(k % 7 == 0, F.concat(F.lit(" \u3000 "), "o_orderstatus", F.lit("\t"))).when(k % 7 == 1, " \n ").when(k % 7 == 2, F.concat(F.lit(" "), F.repeat(F.lit("é"), F.lit(199) + (k % 4).cast("int")))).when(k % 7 < 6, F.col("o_orderstatus"))
    u = o.select(k.alias("upload_id"), name.alias("doc_label"), F.when(k % 3 == 0, F.concat(F.lit("\t"), "o_orderpriority")).when(k % 3 == 1, "").alias("project_id"), F.when(k % 11 == 0, "too_large").alias("error"))
    return ingest.validate_labels(u).select("upload_id", F.coalesce("doc_label", F.lit("-")).alias("doc_label"), F.coalesce("project_id", F.lit("-")).alias("project_id"), F.coalesce("error", F.lit("ok")).alias("outcome"))


def audit_documents(spark, d):
    n = tree.nodes(_headers(spark, d).withColumn("text", F.concat("text", F.lit(" <&>"))))
    md, page, xml = tree.audit_markdown(n), tree.audit_html(n), tree.junit(n)
    rows = md.withColumn("kind", F.lit("md")).unionByName(page.withColumn("kind", F.lit("html"))).unionByName(xml.withColumn("kind", F.lit("xml")))
    return rows.select("doc_id", "kind", F.size(X.lines("value")).alias("n_lines"), F.sha2("value", 256).alias("value_sha"))


QUERIES = {f.__name__: f for f in (header_candidates, header_base_score, header_series_key, header_viable, header_trim, header_typo_boost, header_stitch, header_dedupe, sequence_repair, section_assign, section_text, section_map, header_tree, header_components, header_decision, gap_report, gap_summary, label_validation, audit_documents)}

UP, LET = r"length(regexp_replace({0}, '[^\p{{Lu}}]', '', 'g'))", r"length(regexp_replace({0}, '[^\p{{L}}]', '', 'g'))"
UP, LET = UP.replace("{{", "{").replace("}}", "}"), LET.replace("{{", "{").replace("}}", "}")
up, let = UP.replace("{0}", "text"), LET.replace("{0}", "text")
NTOK = r"len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))"
HEADERS = f"""{T.SERIES},
hd AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, sentence_start, coalesce(ordinal, 0)) AS n, chunk_index % 5 = 0 AS rec, CASE WHEN chunk_index % 4 = 0 THEN 2 ELSE 1 END AS nc FROM series),
ck AS (SELECT user_id AS doc_id, 'k' || event_id AS chunk_id, event_id * 3 + event_id % 4 - 1 AS pos, event_type FROM events),
asg AS (SELECT ck.doc_id, ck.chunk_id, ck.pos, ck.event_type, coalesce(arg_max(hd.n, hd.chunk_index) FILTER (WHERE hd.sentence_start <= ck.pos), arg_min(hd.n, hd.chunk_index)) AS n FROM ck JOIN hd ON hd.doc_id = ck.doc_id GROUP BY 1, 2, 3, 4)"""
SCORED = rf"""sh AS (SELECT *, CASE WHEN regexp_matches(text, '^\d') THEN 'numeric' WHEN regexp_matches(text, '(?i)^appendix\s+[a-z]') THEN 'appendix' WHEN regexp_matches(text, '^[A-Z]\d') THEN 'letter_numeric' END AS sch, {NTOK} AS tok FROM tx),
co AS (SELECT *, round(CASE WHEN sch IS NOT NULL THEN 1.0 WHEN regexp_matches(text, '^\p{{L}}') THEN 0.45 ELSE 0.2 END::DOUBLE, 3) AS regex,
 round(least(1.0::DOUBLE, {up} / greatest({let}, 1) * 0.45::DOUBLE + 0.55::DOUBLE + CASE WHEN level = 1 THEN 0.1 ELSE 0.0 END::DOUBLE), 3) AS style,
 round(greatest(0.2::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - least(tok, 80) / 120.0::DOUBLE)) * 0.8::DOUBLE, 3) AS entropy,
 round(CASE WHEN sch IS NOT NULL AND contains(text, '.') THEN 0.85 WHEN text LIKE '%:' THEN 0.75 ELSE 0.65 END::DOUBLE * 1.1::DOUBLE, 3) AS graph,
 round(least(1.0::DOUBLE, CASE WHEN tok <= 12 THEN 0.7 ELSE 0.5 END::DOUBLE + nc * 0.05::DOUBLE) * 0.9::DOUBLE, 3) AS fluid,
 round(CASE WHEN regexp_matches(lower(text), 'introduction|summary|scope|background|appendix|results|conclusion') THEN 0.85 ELSE 0.65 END::DOUBLE, 3) AS llm_vote FROM sh),
sc AS (SELECT *, round(regex + style + entropy + graph + fluid + llm_vote, 3) AS total FROM co)"""

STITCH = """sr AS (SELECT *, event_id // 50 AS d, CASE WHEN event_id % 7 < 4 THEN 'A' ELSE 'B' END AS k, event_id // 14 AS o FROM (SELECT *, chunk_index AS event_id FROM series)),
r AS (SELECT d, k, o, chunk_index AS ci, text, score, sentence_start AS ss, sentence_end AS se, row_number() OVER (PARTITION BY d ORDER BY chunk_index) AS i FROM sr),
f AS (SELECT d, i, 1 AS island, k, o, ci, text, score, ss, se, 1 AS n FROM r WHERE i = 1
 UNION ALL SELECT r.d, r.i, f.island + CASE WHEN j THEN 0 ELSE 1 END, r.k, r.o, r.ci, CASE WHEN j THEN trim(trim(f.text, ' -:' || chr(10)) || ' ' || trim(r.text, ' -:' || chr(10))) ELSE r.text END, CASE WHEN j THEN greatest(f.score, r.score) ELSE r.score END, CASE WHEN j THEN f.ss ELSE r.ss END, r.se, CASE WHEN j THEN f.n + 1 ELSE 1 END
 FROM f JOIN r ON r.d = f.d AND r.i = f.i + 1, LATERAL (SELECT r.k = f.k AND r.o = f.o AND r.ci = f.ci + 1 AND (length(r.text) <= 40 OR regexp_matches(rtrim(f.text), '[-–:]$')) AS j))"""

ORACLES = {
    "header_stitch": f"WITH RECURSIVE {T.SERIES}, {STITCH} SELECT d AS doc_id, arg_max(ci, i) AS chunk_index, arg_max(k, i) AS section_key, arg_max(o, i) AS ordinal, arg_max(text, i) AS text, arg_max(score, i) AS score, arg_max(ss, i) AS sentence_start, arg_max(se, i) AS sentence_end, CAST(arg_max(n, i) AS INT) AS n_chunks FROM f GROUP BY d, island",
    "header_trim": rf"""WITH {T.TITLES}, w AS (SELECT doc_id, list_filter(string_split_regex(' - ' || text || ' – and more words here', '\s+'), lambda x: x NOT IN ('', '-', '–')) a FROM titles) SELECT doc_id, array_to_string(a[1:CASE WHEN lower(a[1]) IN ('appendix', 'chapter', 'section') THEN 3 WHEN regexp_matches(a[1], '^[A-Z]?\d') THEN 2 ELSE 4 END], ' ') AS trimmed FROM w""",
    "audit_documents": f"""WITH {HEADERS}, tx AS (SELECT * REPLACE (text || ' <&>' AS text) FROM hd), {SCORED}, e AS (SELECT *, text AS m, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS h, ' (score=' || total || ')' AS z, round(least(0.99::DOUBLE, total / 2.0::DOUBLE), 2) AS cf FROM sc),
g AS (SELECT doc_id, count(*) n_h, count(*) FILTER (WHERE rec) n_r, string_agg('- L' || level || ' ' || m || z, chr(10) ORDER BY n) a1, string_agg('- ' || m || ' :: confidence ' || cf, chr(10) ORDER BY n) FILTER (WHERE rec) a2,
 string_agg('<li>L' || level || ' ' || h || z || '</li>', '' ORDER BY n) b1, string_agg('<li>' || h || ' — confidence ' || cf || '</li>', '' ORDER BY n) FILTER (WHERE rec) b2, string_agg('    <testcase classname="headers" name="' || h || '" time="0"/>', chr(10) ORDER BY n) c1 FROM e GROUP BY 1),
v AS (SELECT doc_id, 'md' AS kind, '# Parser Audit for ' || doc_id || chr(10) || chr(10) || 'Detected headers: ' || n_h || chr(10) || 'Recovered gaps: ' || n_r || chr(10) || chr(10) || '## Headers' || chr(10) || a1 || CASE WHEN n_r > 0 THEN chr(10) || chr(10) || '## Gap Repairs' || chr(10) || a2 ELSE '' END || chr(10) AS value FROM g
 UNION ALL SELECT doc_id, 'html', '<html><head><title>Parser Audit for ' || doc_id || '</title></head><body><h1>Parser Audit for ' || doc_id || '</h1><section><h2>Detected Headers</h2><ul>' || b1 || '</ul></section>' || CASE WHEN n_r > 0 THEN '<section><h2>Gap Repairs</h2><ul>' || b2 || '</ul></section>' ELSE '' END || '</body></html>' FROM g
 UNION ALL SELECT doc_id, 'xml', '<testsuite name="parser" tests="' || n_h || '" failures="0">' || chr(10) || c1 || chr(10) || '</testsuite>' || chr(10) FROM g)
SELECT doc_id, kind, CAST(len(string_split(value, chr(10))) AS INT) AS n_lines, sha256(value) AS value_sha FROM v""",
    "header_base_score": rf"""WITH {T.TITLES} SELECT doc_id, text, round(least(0.95::DOUBLE, greatest(
CASE WHEN regexp_matches(text, '(?i)^(?:appendix|chapter|section)\s+[A-Z\d]+(?:[\.\-][A-Z\d]+)*(?:\b|\s|:)') THEN 0.9 ELSE 0 END, CASE WHEN regexp_matches(text, '^\d+(?:\.\d+)+\s+') THEN 0.85 ELSE 0 END, CASE WHEN regexp_matches(text, '^\d+[\.)]\s+') THEN 0.72 ELSE 0 END,
CASE WHEN regexp_matches(text, '(?i)^[A-Z]\d+(?:[\.\-]\d+)*\b') THEN 0.75 ELSE 0 END, CASE WHEN regexp_matches(text, '(?i)^(?:[IVXLCM]+\.)+\s+') THEN 0.7 ELSE 0 END, CASE WHEN regexp_matches(text, '(?i)^(executive summary|introduction|overview|conclusion)\b') THEN 0.62 ELSE 0 END,
CASE WHEN regexp_matches(text, '^[A-Z][A-Z\s]{{4,}}$') THEN 0.65 ELSE 0 END, CASE WHEN {let} > 0 AND {up} / greatest({let}, 1) >= 0.65 THEN 0.55 ELSE 0 END, CASE WHEN text LIKE '%:' THEN 0.6 ELSE 0 END)::DOUBLE + CASE WHEN {NTOK} <= 6 THEN 0.05 ELSE 0 END::DOUBLE), 6) AS score FROM titles""",
    "header_series_key": rf"""WITH {T.TITLES}, m AS (SELECT doc_id, text, regexp_extract(text, '(?i)^(appendix|chapter|section)\s+([A-Z\d]+(?:[\.\-][A-Z\d]+)*)', 1) p, regexp_extract(text, '(?i)^(appendix|chapter|section)\s+([A-Z\d]+(?:[\.\-][A-Z\d]+)*)', 2) b, regexp_extract(text, '^(\d+(?:\.\d+)*)', 1) nu, regexp_extract(text, '^([A-Z](?:[\.\-]\d+)+)', 1) al, regexp_extract(text, '(?i)^([IVXLCM]+)\.', 1) ro FROM titles),
k AS (SELECT *, CASE WHEN b <> '' THEN upper(p[1]) || lower(p[2:]) || ' ' || upper(b) WHEN nu <> '' THEN nu WHEN al <> '' THEN upper(al) WHEN ro <> '' THEN upper(ro) ELSE regexp_replace(regexp_replace(upper(text), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS section_key, regexp_extract_all(CASE WHEN b <> '' THEN b WHEN nu <> '' THEN nu ELSE al END, '\d+') ns FROM m)
SELECT doc_id, section_key, CAST(ns[-1] AS BIGINT) AS ordinal, CAST(greatest(len(ns), 1) AS INT) AS level FROM k""",
    "header_viable": """SELECT o_orderkey, CASE o_custkey % 8 WHEN 3 THEN true ELSE false END AS viable FROM orders""",
    "header_typo_boost": "WITH " + T.SERIES + ", b AS (SELECT chunk_id, score, CASE WHEN chunk_index % 9 + 10 >= 16 THEN 0.2 WHEN chunk_index % 9 + 10 >= 13 THEN 0.1 ELSE 0.0 END::DOUBLE + CASE WHEN chunk_index % 2 = 0 THEN 0.1 ELSE 0.0 END::DOUBLE + CASE WHEN score >= 0.75 AND chunk_index % 9 + 10 >= 14 THEN 0.05 ELSE 0.0 END::DOUBLE AS boost FROM series) SELECT chunk_id, round(CASE WHEN boost > 0 THEN least(1.0::DOUBLE, score + boost) ELSE score END, 6) AS score, round(boost, 6) AS boost FROM b",
    "header_dedupe": f"WITH {T.SERIES} SELECT doc_id, section_key, ordinal, chunk_index, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section_key, ordinal ORDER BY score DESC, chunk_index DESC) rn FROM series) WHERE rn = 1",
    "sequence_repair": f"""WITH {T.SERIES}, a AS (SELECT *, score >= 0.55 AS st, score >= 0.35 AND score < 0.55 AS wk, bool_or(score >= 0.55) OVER (PARTITION BY doc_id, section_key) AS has FROM series),
pr AS (SELECT *, wk AND NOT has AND row_number() OVER (PARTITION BY doc_id, section_key, wk ORDER BY score DESC, coalesce(ordinal, 0), chunk_index) = 1 AS pro FROM a),
s AS (SELECT *, lead(ordinal) OVER (PARTITION BY doc_id, section_key ORDER BY coalesce(ordinal, 0), chunk_index) AS nx, min(ordinal) OVER (PARTITION BY doc_id, section_key) mn, max(ordinal) OVER (PARTITION BY doc_id, section_key) mx FROM pr WHERE st OR pro),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section_key, ordinal ORDER BY score DESC, chunk_index) rn FROM pr WHERE wk AND ordinal IS NOT NULL) WHERE rn = 1)
SELECT doc_id, chunk_id, section_key, ordinal, score, pro AS recovered FROM s UNION ALL SELECT doc_id, chunk_id, section_key, ordinal, score, true FROM w WHERE EXISTS (SELECT 1 FROM s WHERE s.doc_id = w.doc_id AND s.section_key = w.section_key AND ((w.ordinal > s.ordinal AND w.ordinal < s.nx) OR w.ordinal < s.mn OR w.ordinal > s.mx))""",
    "section_assign": f"WITH {HEADERS} SELECT doc_id, chunk_id, pos AS sentence_start, doc_id || ':h' || n AS header_id FROM asg",
    "section_text": f"WITH {HEADERS}, g AS (SELECT doc_id, n, count(*) c, string_agg(event_type, chr(10) || chr(10) ORDER BY pos, chunk_id) t FROM asg GROUP BY 1, 2) SELECT hd.doc_id, hd.doc_id || ':s' || hd.n AS section_id, hd.doc_id || ':h' || hd.n AS header_id, CAST(coalesce(c, 0) AS INT) AS n_chunks, sha256(text || coalesce(chr(10) || chr(10) || t, '')) AS text_sha, level FROM hd LEFT JOIN g ON g.doc_id = hd.doc_id AND g.n = hd.n",
    "section_map": f"WITH {HEADERS} SELECT asg.doc_id, asg.doc_id || ':s' || asg.n AS section_id, asg.doc_id || ':h' || asg.n AS header_id, asg.chunk_id, row_number() OVER (PARTITION BY asg.doc_id ORDER BY hd.sentence_start, hd.chunk_index, asg.pos, asg.chunk_id) - 1 AS \"order\" FROM asg JOIN hd ON hd.doc_id = asg.doc_id AND hd.n = asg.n",
    "header_tree": f"WITH {HEADERS} SELECT a.doc_id, 'header:' || a.doc_id || ':' || a.n AS node_id, 'header:' || a.doc_id || ':' || max(b.n) AS parent_id, a.level FROM hd a LEFT JOIN hd b ON b.doc_id = a.doc_id AND b.n < a.n AND b.level < a.level GROUP BY a.doc_id, a.n, a.level",
    "header_components": f"WITH {HEADERS}, {T.TITLES}, tx AS (SELECT hd.doc_id, hd.n, hd.level, hd.nc, titles.text FROM hd JOIN titles ON titles.doc_id = hd.chunk_index), {SCORED} SELECT 'header:' || doc_id || ':' || n AS node_id, text, regex, style, entropy, graph, fluid, llm_vote, total, coalesce(sch, 'none') AS schema, CASE WHEN total < 0.5 THEN 'reject' WHEN total < 0.65 THEN 'promote.subheader' ELSE 'promote.header' END AS decision, nc > 1 AS joined FROM sc",
    "header_decision": f"WITH {T.SERIES} SELECT chunk_id, CASE WHEN score < 0.5 THEN 'reject' WHEN score < 0.65 THEN 'promote.subheader' ELSE 'promote.header' END AS decision FROM series",
    "gap_summary": f"WITH {HEADERS}, z AS (SELECT *, CASE chunk_index % 3 WHEN 0 THEN 'appendix' WHEN 1 THEN 'numeric' ELSE 'letter_numeric' END AS sch FROM hd) SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list(sch) FILTER (WHERE rec))), ','), 'numeric') AS schemas, count(*) FILTER (WHERE rec) AS holes FROM z GROUP BY 1",
    "label_validation": """WITH u AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus WHEN o_orderkey % 7 = 2 THEN repeat('é', 199 + o_orderkey % 4) WHEN o_orderkey % 7 IN (3, 4, 5) THEN o_orderstatus END AS l, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS p FROM orders)
SELECT k AS upload_id, coalesce(l, '-') AS doc_label, coalesce(p, '-') AS project_id, CASE WHEN k % 11 = 0 THEN 'too_large' WHEN length(l) > 200 THEN 'invalid_doc_label' ELSE 'ok' END AS outcome FROM u""",
    "gap_report": f"WITH {HEADERS}, tx AS (SELECT * FROM hd), {SCORED}, lr AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY n) l, lead(text) OVER (PARTITION BY doc_id ORDER BY n) r FROM sc) SELECT doc_id, n, text AS expected, coalesce(sch, 'numeric') AS schema, coalesce(l, '-') AS \"left\", coalesce(r, '-') AS \"right\", round(least(nc, 4) * 0.05::DOUBLE + 0.7::DOUBLE, 2) AS style_sim, CASE WHEN coalesce(sch, 'numeric') <> 'numeric' THEN 0.8 ELSE 0.7 END::DOUBLE AS graph_adj, round(least(0.99::DOUBLE, total / 2.0::DOUBLE), 2) AS confidence FROM lr WHERE rec",
}
