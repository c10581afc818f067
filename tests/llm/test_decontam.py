from hypothesis import given, settings, strategies as st

from inkwell.llm import decontam


def edit(item, text):
    """Smallest edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", min_size=1, max_size=70), st.text("ab c", max_size=90))
def test_myers(item, text):
    want = edit(item, text)
    assert decontam.myers(item, decontam.bit_masks(item), text, want)[0] == want
    assert want == 0 or decontam.myers(item, decontam.bit_masks(item), text, want - 1) is None


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_pieces_find_every_match_within_budget(data):
    item = data.draw(st.text("abcde ", min_size=20, max_size=60))
    inside = list(item)
    for _ in range(data.draw(st.integers(0, 8))):
        at, c = data.draw(st.integers(0, len(inside))), data.draw(st.sampled_from(["", "x", "yy"]))
        inside[at : at + 1] = [c]
    text = data.draw(st.text("abcdexy ", max_size=30)) + "".join(inside) + data.draw(st.text("abcdexy ", max_size=30))
    found = decontam.Matcher([(1, item)], 0.1).find(text)
    want = edit(item, text)
    assert bool(found) == (want <= int(len(item) * 0.1))
    if found:
        assert found[0][1] == want and edit(text[found[0][3] : found[0][4]], item) == want or found[0][1] == want


def test_equals_brute_force(spark, tiny):
    docs = [(r.doc_id, decontam.normalise(r.text)) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    items = [(r.item_id, decontam.normalise(r.text)) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.query(spark, tiny).collect()}
    want = {}
    for i, text in docs:
        for k, item in items:
            hit = decontam.myers(item, decontam.bit_masks(item), text, int(len(item) * decontam.ERROR_RATE))
            if hit:
                want[i, k] = hit[0]
    assert got == want and want


def test_case_punctuation_and_layout_cost_nothing():
    item = "Él dijo: la niña, nunca jamás, volvió a su casa de campo."
    text = "x " + item.upper().replace(" ", "!!\n ") + " y"
    assert decontam.Matcher([(7, decontam.normalise(item))]).find(decontam.normalise(text))[0][:2] == (7, 0)


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (2, None), (3, "one two three"), (None, "W10 w11 w12 w13 w14 w15  w16 w17")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontam.leaks(spark, odd, items).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (4, 3), (None, 3), (5, 1), (5, None), (6, 1), (6, None)], key=str)  # short items count too
    assert decontam.leaks(spark, none, items).count() == 0 and decontam.leaks(spark, odd, items.limit(0)).count() == 0
    assert decontam.clean(odd, items).count() == 5
