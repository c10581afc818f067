from inkwell.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) {"</p>"}</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div>
<div id="sidebar">Side</div><main><article><header><h1>The  title &amp; more</h1></header><p>One<br>two &eacute;&nbsp;&#x41; <b>bold</b><i>x</i>
<p>Second <!-- hidden --> para<div class="ad-slot">Buy</div><ul><li>a<li>b</ul><form><input>Search</form><p>Third</article>
<section class="comments"><p>First!</p></section></main><footer>&copy; site</footer></body></html>"""


def text(source, deleted=frozenset()):
    return html.main_text(html.parse(source), set(deleted))


def test_article_only():
    assert text(PAGE) == "The title & more\n\nOne two é A boldx\n\nSecond para\n\na\n\nb\n\nThird"


def test_fallbacks_and_broken_markup():
    assert text("") == "" and text("plain &lt;b&gt;") == "plain <b>"
    assert text("<div><p>Body text</p><ul><li><a href=x>link</a></ul></div>") == "Body text"
    assert text("<p>a<script>never closed") == "a" and text("a < b and <c") in ("a < b and", "a < b and <c")
    assert text("<article><p>x<article class=comment><p>no</article></article>") == "x"
    assert text("<article><table><tr><td>1<td>2<tr><td>3</table></article>") == "1\n\n2\n\n3"
    assert text("<article><p title='a>b' data-x=\"<p>\">ok</article>") == "ok"
    assert text("<div " * 5000) == "" and text("<div>" * 3000 + "deep") == "deep"


def test_every_page_of_the_table(spark, tiny):
    import re

    pages = {r.page_id: r for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    rows = html.query(spark, tiny).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        inside = pages[r.page_id].html.split("<article>")[1].split("</article>")[0]
        parts = re.split(r"</?(?:h1|p)>", inside)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in p else "", p.replace("<br>", " "))).split()) for p in parts]
        assert r.text == "\n\n".join(p for p in want if p) and r.n_chars == len(r.text)


def test_templates_of_a_host_go(spark):
    def page(i, extra):
        return f"<body><div class=top><p>Welcome to the site</p></div><article><p>Story {i}</p>{extra}<div><p>Follow us</p></div></article><div><p>Made with care</p></div></body>"

    rows = [(i, f"http://h{i % 2}.example.com/{i}", page(i, "<p>Quoted passage</p>" if i % 3 else "")) for i in range(40)]
    got = {r.page_id: r.text for r in html.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Story 1\n\nQuoted passage" and got[3] == "Story 3"


def test_odd_rows(spark):
    rows = [(1, None, None, 1, "h"), (2, "http://a/", "", 2, "h"), (None, "http://a/", "<p>x</p>", 3, "h"), (3, "not a url", "<article>y</article>", 4, "h"), (3, "not a url", "<article>y</article>", 4, "h"), (4, "http://a/", "<p>" + "word " * 100_000, 5, "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, hash int, host string")
    got = sorted(((r.page_id, r.n_chars) for r in html.extract(spark, df).collect()), key=str)
    assert got == sorted([(1, 0), (2, 0), (None, 1), (3, 1), (3, 1), (4, 499_999)], key=str)
    assert html.extract(spark, df.limit(0)).count() == 0
