from inkwell.llm import html


def test_templates_below_half_of_a_large_host_go(spark):
    def page(i):
        advert = f"<div><p>Our advert number {i % 3} for you</p></div>" + (f"<div><p>Layout of section {i // 120} only</p></div>" if i < 1200 else "")
        notice = "<div><p>This story is kept for our readers</p></div>" if i % 5 else ""
        quoted = "<p>A passage that several articles quote</p>" if i % 4 == 0 else ""
        return f"<body>{advert}<article><p>Story {i}</p>{quoted}{notice}</article></body>" if i < 2000 else f"<body>{advert}<div><p>Story {i}</p></div><div><p>Yes{'' if i % 20 else ' no'}</p></div></body>"

    rows = [(i, f"http://big.example.com/{i}", page(i)) for i in range(2100)]
    got = {r.page_id: r.text for r in html.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Story 1" and got[4] == "Story 4\n\nA passage that several articles quote"
    assert got[2001] == "Story 2001\n\nYes" and got[2020] == "Story 2020\n\nYes no"
