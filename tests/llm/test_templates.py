"""Templates against a plain count of paragraphs over different pages, with copies, mirrors and shared ids."""

from collections import defaultdict

from inkwell.llm import html

ROWS = "page_id long, url string, html string"


def body(i, extra=""):
    return f"<body><div><p>Welcome to the house</p></div><div><p>Text {i}</p>{extra}</div><div><p>Made here</p></div></body>"


def got(spark, rows, **options):
    return sorted((r.page_id, r.url, r.text, r.n_chars) for r in html.extract(spark, spark.createDataFrame(rows, ROWS), **options).collect())


def test_rows_and_mirrors_do_not_delete_one_another(spark):
    page = "<body><article><p>One story</p><p>told once</p></article></body>"
    plain = "<body><div><p>Only text</p></div></body>"
    rows = [(1, "http://a/x", page)] * 7 + [(10 + i, f"http://a/{i}", page) for i in range(6)] + [(30 + i, f"http://b/{i}", plain) for i in range(9)]
    rows += [(50 + i, f"http://c/{i}", page.replace("</body>", f"<footer>visit {i}</footer></body>")) for i in range(8)]  # mirrors that differ in furniture
    for page_id, _, text, n in got(spark, rows):
        want = "Only text" if 30 <= page_id < 50 else "One story\n\ntold once"
        assert text == want and n == len(want)


def test_against_a_plain_count(spark):
    """Every page is three divisions of paragraphs; a division goes if it is on enough different pages of its host."""
    rows = []
    for i in range(24):
        host = "abc"[i % 3]
        rows += [(i, f"http://{host}.org/{i}", body(i, "<p>Seen twice</p>" if i in (0, 3) else ""))] * (1 + 6 * (i % 5 == 0))
    rows += [(1, "http://a.org/other", body("under another host")), (2, "http://d.org/1", body("alone")), (None, "http://a.org/null", body("without id")), (77, None, body("without url"))]
    parts = lambda page: [x.split("</div>")[0] for x in page.split("<div>")[1:]]
    pages = defaultdict(set)
    for _, url, page in rows:
        pages[html_host(url)].add(page)
    for page_id, url, text, _ in [(r.page_id, r.url, r.text, r.n_chars) for r in html.extract(spark, spark.createDataFrame(rows, ROWS)).collect()]:
        candidates = [page for i, u, page in rows if (i, u) == (page_id, url)]
        own = pages[html_host(url)]
        count = lambda part: sum(part in parts(p) for p in own)
        kept = [x for x in parts(candidates[0]) if not (count(x) >= html.MIN_PAGES and 2 * count(x) >= len(own))]
        assert text == "\n\n".join(t.split("</p>")[0] for x in kept for t in x.split("<p>")[1:])


def html_host(url):
    return url.split("/")[2] if url else ""


def test_deletion_changes_pages_without_telling_markup(spark):
    rows = [(i, f"http://a.org/{i}", body(i)) for i in range(8)]
    off, on = got(spark, rows, templates=False), got(spark, rows)
    assert [t for _, _, t, _ in on] == [f"Text {i}" for i in range(8)]
    assert all(t == f"Welcome to the house\n\nText {i}\n\nMade here" for i, (_, _, t, _) in enumerate(off))


def test_one_id_under_two_urls(spark):
    rows = [(i, f"http://a.org/{i}", body(i)) for i in range(5)] + [(0, f"http://b.org/{i}", body(f"b{i}").replace("Welcome", "Willkommen")) for i in range(5)]
    assert sorted(t for _, _, t, _ in got(spark, rows)) == sorted([f"Text {i}" for i in range(5)] + [f"Text b{i}" for i in range(5)])


def text(source):
    return html.main_text(html.parse(source), set())


def test_all_articles_and_undeclared_names():
    assert text("<main><h1>x</h1><article><p>a</article><article><p>bb</article></main>") == "a\n\nbb"
    assert text("<p><a href=x>See the appendix</a></p>") == "See the appendix"
    assert text("<article><div class=social-history>kept</div><div class='ad-slot'>gone</div><div id=relatedPosts>gone</div><p class=notice>gone</p></article>") == "kept"
    assert text("<div><a>Home</a> | <a>News</a> | <a>Contact</a></div><p>Text</p>") == "Text"
    assert text("<article class=post-with-comments><p>story</p><article class='comment odd'>reply</article></article>") == "story"


def test_an_article_is_no_template():
    found = html.subtrees(html.parse("<body><div><section><article><p>x</p></article></section></div><div><p>y</p></div></body>"))
    assert sum(inside for _, inside, _ in found.values()) == 1 and len(found) == 3


def test_joined_templates_equal_broadcast_ones(spark, monkeypatch):
    rows = [(i, f"http://{'ab'[i % 2]}.org/{i % 9}", body(i // 2)) for i in range(30)] * 2 + [(99, None, None)]
    want = got(spark, [(i or 0, u or "", h) for i, u, h in rows])
    monkeypatch.setattr(html, "BROADCAST_TEMPLATES", -1)
    assert got(spark, [(i or 0, u or "", h) for i, u, h in rows]) == want and any(t == "Text 3" for _, _, t, _ in want)
