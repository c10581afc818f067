"""Operators against plain restatements of their rules, on authored rows."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from inkwell.functions import text as X
from inkwell.operators import chunk, enrich, headers, ingest, passes, search, sections, tree

TEXT = """1. Introduction

The pump train lifts water. It runs at 50 Hz! Does it hold?

1.1 Scope

- first bullet
* second bullet

name | unit
flow | 12

[image:Pump curve]

See https://example.com/a?b=1, now.

Appendix A – Tables"""


def one(spark, text, **more):
    return spark.createDataFrame([(1, text, *more.values())], ["doc_id", "text", *more])


def test_curated_text(spark):
    docs = one(spark, TEXT)
    pages = ingest.pages(docs)
    assert [(r.page_number, len(r.blocks), r.n_images, r.coverage) for r in pages.collect()] == [(1, 7, 1, 1.0)]
    blocks = ingest.blocks(pages)
    assert blocks.first().block_id == "1:p1:b1"
    assert ingest.images(docs).first().description == "Pump curve"
    assert [(r.prefix, r.body) for r in enrich.list_items(blocks).orderBy("block_id", "item_no").collect()] == [("1.", "Introduction"), ("-", "first bullet"), ("*", "second bullet")]
    assert [r.cells for r in enrich.table_rows(pages).orderBy("row_no").collect()] == [["name", "unit"], ["flow", "12"]]
    link = enrich.links(pages, ["doc_id"]).first()
    text = pages.first().text
    assert text[link.start : link.end] == link.url == "https://example.com/a?b=1,"
    assert [r.sentence for r in chunk.sentences(docs).orderBy("sentence_no").collect()][:4] == ["1.", "Introduction", "The pump train lifts water.", "It runs at 50 Hz!"]


def test_pages_blank_and_broken(spark):
    rows = ingest.pages(one(spark, "a\n\n\n\n  \fb\n\nc\n \nd")).orderBy("page_number").collect()
    assert [(r.blocks, r.coverage) for r in rows] == [(["a"], 1.0), ([], 0.0), (["b", "c\n \nd"], 1.0)]
    done = ingest.ocr_fallback(ingest.pages(one(spark, "a\n\n\n[image:x]"))).orderBy("page_number").collect()
    assert [(r.blocks, r.coverage, r.ocr) for r in done] == [(["a"], 1.0, False), (["OCR recovered text"], 1.0, True)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.booleans()), max_size=60), st.sampled_from([0, 10, 24, 90]), st.sampled_from([0, 6, 12, 40]))
def test_chunks_cover_and_advance(sentences, target, overlap):
    tokens, heading = [t for t, _ in sentences], [h for _, h in sentences]
    out = chunk.pack(tokens, heading, target, overlap)
    assert sorted({i for a, b in out for i in range(a, b + 1)}) == list(range(len(tokens)))
    assert all(a < c and c <= b + 1 for (a, b), (c, _) in zip(out, out[1:]))
    for a, b in out:
        assert sum(tokens[a:b]) < max(target or 90, 10) and not any(heading[a + 1 : b + 1])


def test_series_keys_and_scores(spark):
    rows = ["Appendix A-2.1 Pumps", "1.2.3 Flow", "A.4 Motors", "IV. Power", "", "Overview of it", "POWER SUPPLY", "chapter 7"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", headers.series_key("t").alias("k"), headers.base_score("t").alias("s")).orderBy("i")
    got = [((r.k.key, r.k.ordinal, r.k.level), round(r.s, 2)) for r in df.collect()]
    assert got == [(("Appendix A-2.1", 1, 2), 0.95), (("1.2.3", 3, 3), 0.9), (("A.4", 4, 1), 0.05), (("IV", None, 1), 0.75), (("root", None, 1), 0.05), (("OVERVIEW-OF-IT", None, 1), 0.67), (("POWER-SUPPLY", None, 1), 0.7), (("Chapter 7", 7, 1), 0.95)]


def test_viable(spark):
    rows = {"12 mm": False, "12.5 kHz": False, "ab": False, "AB CD": False, "Section 2": True, "1,200 rpm": False, "3 bolts": True, "-": False, "12 %": False}
    df = spark.createDataFrame([(t,) for t in rows], "t string").select("t", headers.viable("t").alias("v"))
    assert {r.t: r.v for r in df.collect()} == rows


def test_candidates_inline_and_whole(spark):
    rows = [(1, "1:c1", 0, "Intro text. 2.1 Pump design, see Appendix B Tables: rest", 0, 3), (1, "1:c2", 1, "OVERVIEW of the plant:", 4, 4), (1, "1:c3", 2, "plain prose without a title that goes on for long enough", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_id string, chunk_index long, text string, sentence_start long, sentence_end long")
    got = sorted((r.chunk_index, r.text, r.section_key, r.sentence_start) for r in headers.candidates(df).collect())
    assert got == [(1, "2.1 Pump", "2.1", 1), (1, "OVERVIEW of the plant:", "OVERVIEW-OF-THE-PLANT", 4), (2, "Appendix B Tables", "Appendix B", 2)]


HEADER = "doc_id long, chunk_id string, chunk_index long, section_key string, ordinal long, score double, level int, text string, sentence_start long, sentence_end long, recovered boolean"


def plain_stitch(rows):
    out = []
    for r in sorted(rows, key=lambda r: r["chunk_index"]):
        p = out[-1] if out else None
        if p and (p["section_key"], p["ordinal"]) == (r["section_key"], r["ordinal"]) and r["chunk_index"] == p["chunk_index"] + 1 and (len(r["text"]) <= 40 or p["text"].rstrip().endswith(("-", "–", ":"))):
            p["text"] = " ".join(t.strip(" -:\n") for t in (p["text"], r["text"]) if t).strip()
            p["score"], p["chunk_index"], p["sentence_end"] = max(p["score"], r["score"]), r["chunk_index"], max(p["sentence_end"], r["sentence_end"])
            p["ids"] = [*p["ids"], r["chunk_id"]]
        else:
            out.append(r | {"ids": [r["chunk_id"]]})
    return out


def test_parents_at_any_depth(spark):
    rng = random.Random(2)
    rows = [(d, n, rng.choice([1, 2, 3, 23, 24, 25, 26, 40])) for d in range(6) for n in range(1, 60)]
    want = {}
    for d, n, level in rows:
        above = [m for e, m, other in rows if e == d and m < n and other < level]
        want[d, n] = max(above) if above else None
    got = {(r.doc_id, r.n): r.parent for r in tree.parents(spark.createDataFrame(rows, "doc_id long, n long, level int")).collect()}
    assert got == want and any(v is None for v in got.values())


def test_stitch_equals_a_loop(spark):
    rng = random.Random(4)
    docs = {}
    for d in range(60):
        docs[d] = [dict(doc_id=d, chunk_id=f"c{i}", chunk_index=i + rng.randrange(2) * 50, section_key=rng.choice("AB"), ordinal=rng.choice([1, 1, None]), score=rng.randrange(100) / 100, level=1, text=rng.choice(["short", "dash -", "colon:", "long " * 12, "long –" * 9, " - x"]), sentence_start=i, sentence_end=i, recovered=False) for i in range(12)]
    df = spark.createDataFrame([tuple(r.values()) for rows in docs.values() for r in rows], HEADER)
    got = sorted((r.doc_id, r.chunk_index, r.text, r.score, r.sentence_end, tuple(r.chunk_ids)) for r in headers.stitch(df).collect())
    want = sorted((d, r["chunk_index"], r["text"], r["score"], r["sentence_end"], tuple(r["ids"])) for d, rows in docs.items() for r in plain_stitch([dict(x) for x in rows]))
    assert got == want


def test_repair_recovers_the_hole(spark):
    rows = [(1, "c1", 1, "A", 1, 0.8, 1, "A1", 0, 0, False), (1, "c2", 2, "A", 2, 0.4, 1, "A2", 1, 1, False), (1, "c3", 3, "a", 3, 0.7, 1, "A3", 2, 2, False), (1, "c4", 4, "A", 3, 0.5, 1, "dup", 3, 3, False), (2, "c5", 5, "B", 9, 0.36, 1, "B9", 0, 0, False), (2, "c6", 6, "B", 8, 0.5, 1, "B8", 0, 0, False), (3, "c7", 7, None, None, 0.2, 1, "no", 0, 0, False)]
    got = sorted((r.doc_id, r.ordinal, r.recovered) for r in headers.repair(spark.createDataFrame(rows, HEADER)).collect())
    assert got == [(1, 1, False), (1, 2, True), (1, 3, False), (2, 8, True), (2, 9, True)]


def test_dedupe_prefers_score_then_the_later(spark):
    rows = [(1, f"c{i}", i, "A", 1, s, 1, "t", 0, 0, False) for i, s in enumerate([0.5, 0.9, 0.9, 0.1])]
    assert [r.chunk_index for r in headers.dedupe(spark.createDataFrame(rows, HEADER)).collect()] == [2]


def test_sections_as_of(spark):
    h = spark.createDataFrame([(1, "h1", "s1", 0, 0, 1, 0.9, False, "One", 0), (1, "h2", "s2", 4, 4, 1, 0.9, False, "Two", 1), (1, "h3", "s3", 4, 5, 1, 0.9, False, "Three", 2)], "doc_id long, header_id string, section_id string, sentence_start long, sentence_end long, level int, score double, recovered boolean, text string, chunk_index long")
    c = spark.createDataFrame([(1, f"c{i}", s, t) for i, (s, t) in enumerate([(-1, "before"), (0, "a"), (3, " "), (4, "b"), (9, "c")])] + [(2, "x", 0, "none")], "doc_id long, chunk_id string, sentence_start long, text string")
    a = sections.assign(h, c)
    assert {r.chunk_id: r.header_id for r in a.collect()} == {"c0": "h1", "c1": "h1", "c2": "h1", "c3": "h3", "c4": "h3"}
    s = {r.header_id: (r.text, r.chunk_ids) for r in sections.sections(h, c, a).collect()}
    assert s == {"h1": ("One\n\nbefore\n\na", ["c0", "c1", "c2"]), "h2": ("Two", []), "h3": ("Three\n\nb\n\nc", ["c3", "c4"])}
    m = sections.section_map(sections.sections(h, c, a)).orderBy("order").collect()
    assert [(r.chunk_id, r.order) for r in m] == [("c0", 0), ("c1", 1), ("c2", 2), ("c3", 3), ("c4", 4)]


def test_tree_parents_equal_a_stack(spark):
    rng = random.Random(1)
    rows = [(d, n, rng.randrange(1, 7)) for d in range(20) for n in range(1, 40)]
    got = {(r.doc_id, r.n): r.parent for r in tree.parents(spark.createDataFrame(rows, "doc_id long, n long, level int")).collect()}
    for d in range(20):
        stack = []
        for _, n, level in (r for r in rows if r[0] == d):
            while stack and stack[-1][1] >= level:
                stack.pop()
            assert got[d, n] == (stack[-1][0] if stack else None)
            stack.append((n, level))


def test_decisions_and_renderings(spark):
    w = tree.Weights()
    df = spark.createDataFrame([(0.49,), (0.5,), (0.65,)], "t double").select(tree.decision(F.col("t"), w).alias("d"))
    assert [r.d for r in df.collect()] == ["reject", "promote.subheader", "promote.header"]
    assert "regex = 1.000" in w.toml()
    n = tree.nodes(spark.createDataFrame([(1, 1, "1. A & B", 1, ["c1", "c2"], False), (1, 2, "1.1 <x>", 2, ["c3"], True)], "doc_id long, n long, text string, level int, chunk_ids array<string>, recovered boolean"))
    md, page, xml = (f(n).first().value for f in (tree.audit_markdown, tree.audit_html, tree.junit))
    assert md.startswith("# Parser Audit for 1\n\nDetected headers: 2\nRecovered gaps: 1\n\n## Headers\n- L1 1. A & B (score=") and "## Gap Repairs\n- 1.1 <x> :: confidence" in md
    assert "A &amp; B" in page and "<h2>Gap Repairs</h2>" in page and 'tests="2"' in xml and "1.1 &lt;x&gt;" in xml
    roots = tree.with_roots(n, spark.createDataFrame([(1,), (7,)], "doc_id long")).where("doc_id = 7").collect()
    assert [(r.node_id, r.text) for r in roots] == [("header:7:root", "Document")]


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(0, "fire alarm panel"), (1, "control loop control valve"), (2, "the control room")], "doc_id long, text string")
    rows = search.top(search.bm25(docs, "control"), 3).collect()
    assert [r.doc_id for r in rows] == [1, 2, 0] and rows[0].score > rows[1].score > rows[2].score == 0
    dense = spark.createDataFrame([(1, 1.0), (0, 0.2)], "doc_id long, score double")
    assert [(r.doc_id, r.sparse) for r in search.fuse(docs.select("doc_id", F.lit(0.0).alias("score")), dense, 1, 1.0).collect()] == [(1, 0.0)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in search.top(search.dense(v, F.array(F.lit(2.0), F.lit(0.0))), 2, "vec_id").collect()] == [(1, 1.0), (2, 0.0)]
    with pytest.raises(Exception, match="dimension"):
        search.dense(v, F.array(F.lit(2.0))).collect()


def test_passes(spark):
    rows = [(1, 0, "doc:c1", "mechanical loads on 12 bolts engineering", 6, 0, 1, "A/B"), (1, 1, "doc:c2", "electrical power budget", 3, 2, 2, None), (1, 2, "doc:c3", "schedule of the project", 4, 3, 3, "A")]
    chunks = spark.createDataFrame(rows, "doc_id long, idx int, chunk_id string, text string, token_count int, sentence_start int, sentence_end int, header_path string")
    ranked = passes.retrieve(spark, chunks)
    by = {}
    for r in ranked.orderBy("domain", "rank").collect():
        by.setdefault(r.domain, []).append(r)
    assert set(by) == set(passes.PROMPTS) and by["mechanical"][0].chunk_id == "doc:c1" and by["electrical"][0].chunk_id in ("doc:c1", "doc:c2")
    assert all(a.total_score >= b.total_score for x in by.values() for a, b in zip(x, x[1:]))
    done = passes.results(spark, ranked).collect()
    assert len(done) == 5 and all(len(r.citations) == 3 and len(r.retrieval) == 3 and "\n\nAnswer: " in r.answer for r in done)
    assert {r.pass_id for r in done} == {f"1:{d.replace('_', '-')}" for d in passes.PROMPTS}
    assert set(passes.manifest(passes.results(spark, ranked)).first().passes) == set(passes.PROMPTS)


def test_context_budget(spark):
    rows = [(1, "d", 1, "a", "one two three", "H"), (1, "d", 2, "a", "dup", None), (1, "d", 3, "b", "four five six", None), (1, "d", 4, "c", "x", None)]
    ranked = spark.createDataFrame(rows, "doc_id long, domain string, rank int, chunk_id string, text string, header_path string")
    assert [r.context for r in passes.contexts(ranked, 5).collect()] == ["[H] one two three"]
    assert [r.context for r in passes.contexts(ranked, 6).collect()] == ["[H] one two three\n\nfour five six"]


def test_functions(spark):
    df = spark.createDataFrame([("  Über %5 ±", "Bearer abcdefghijkl", "A b__c!.tar.GZ")], "t string, h string, f string")
    r = df.select(X.energy_score(F.lit("A1%°b")).alias("e"), X.mask_header("h").alias("m"), X.file_slug("f").alias("f"), X.slug(F.lit(" A_b ")).alias("s"), X.hash_embedding(F.lit("")).alias("z"), X.double_extension(F.lit("a.exe.pdf")).alias("x"), X.mime(F.lit(b"%PDF-1")).alias("mt"), X.graph_score(F.lit("a/b")).alias("g")).first()
    assert (r.e, r.m, r.f, r.s, r.x, r.mt, r.g) == (0.8, "Bearer abcd...ijkl", "A-b__c-.tar.GZ", "a-b", True, "application/pdf", 0.6) and set(r.z) == {0.0}


def test_hot_checksums_are_salted(spark, monkeypatch):
    monkeypatch.setattr(ingest, "HOT_ROWS", 5)
    files = ingest.checksums(spark.createDataFrame([(i, "hot" if i % 3 else f"t{i}") for i in range(60)], "doc_id long, text string"), "text")
    rows = ingest.dedupe_uploads(files).collect()
    assert len(rows) == 60 and sum(r.status == "duplicate" for r in rows) == 39 and {r.owner for r in rows if r.status == "duplicate"} == {1}


def test_upload_records(spark):
    files = ingest.checksums(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "doc_id long, text string"), "text")
    assert [(r.doc_id, r.status, r.owner) for r in ingest.dedupe_uploads(files).orderBy("doc_id").collect()] == [(1, "new", 1), (2, "duplicate", 1), (3, "new", 3), (4, "new", 4)]
    records = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), (" ", 3, "bad"), (None, 4, "bad")], "k string, v int, x string")
    assert [(r.k, r.x) for r in ingest.upsert(records, "k", "v").collect()] == [("a", "new")]


def test_fonts_and_tokens(spark):
    spans = spark.createDataFrame([("b", 0, "Arial", 10.0), ("b", 1, "Arial-BoldItalic", 12.0), ("b", 2, "Arial", 11.0)], "block string, pos int, family string, size double")
    r = enrich.font_summary(spans, "block").first()
    assert (r.family, r.size, r.bold, r.italic) == ("Arial", 11.0, True, True)
    blocks = ingest.blocks(ingest.pages(one(spark, "a\n\nb")))
    stats = spark.createDataFrame([(1, False, 0.5)], "doc_id long, ocr_performed boolean, avg_coverage double")
    assert enrich.ocr_tokens(blocks, stats).count() == 2 and enrich.ocr_tokens(blocks, stats.withColumn("avg_coverage", F.lit(0.9))).count() == 0
