from inkwell.llm import warc

PAGE = """<!DOCTYPE html><!-- <html lang="xx"> {} --><html class="a > b" lang='pt-BR'><head><title>T</title><style>p {{}}</style></head><body class="widget">
<header>Site</header><nav><a href="/">Home</a></nav><div class="ad-slot">Buy</div><script>x()</script><template><p>t</p></template>
<article><h1>Title</h1><p>One <b>two</b></p></article><p hidden>no</p><p style="display: none">no</p><aside>Side</aside>
<section class="comments"><p>First!</p></section><form><label>Name</label><button>Send</button></form><dialog open>Ask</dialog>
<footer>&copy; site</footer></body><p>After</p></html><div>Last</div>"""
LINES = ["Site", "Home", "Buy", "Title", "One two", "Side", "First!", "Name Send", "Ask", "© site", "After", "Last"]


def test_all_visible_text_stays():
    assert warc.plain_text(PAGE.format("")).replace("NameSend", "Name Send").split("\n") == LINES
    assert warc.plain_text("<html><head><meta charset=x><title>T</title><body><p>x") == "x"
    assert warc.plain_text("a<body>b</body>c<body>d</body>").split() == ["a", "b", "c", "d"]


def test_language_is_found_in_the_whole_source():
    for long in ("", "x" * 10_000):
        records = warc.derive("<r>", None, None, "", PAGE.format(long).encode())
        assert b"language: pt-br\r\n" in records[1][-1]
    assert warc.language("<html data-lang=x><p lang=en>") is None and warc.language("<html LANG=en>") == "en"
