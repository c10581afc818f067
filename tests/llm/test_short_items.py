from inkwell.llm import decontam


def test_short_items_are_searched(spark):
    items = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "法国的首都是哪里?"), (3, "ประเทศไทยมีกี่จังหวัดในปัจจุบันและจังหวัดใดใหญ่ที่สุด"), (4, "art"), (5, "?!"), (6, "What is the capital city of France")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "quiz: who wrote hamlet, and why"), (2, "问题:法国的首都是哪里呢"), (3, "ถาม ประเทศไทยมีกี่จังหวัดในปัจจุบันและจังหวัดใดใหญ่ที่สุด ตอบ"), (4, "start of a party"), (5, "start of Art."), (6, "what is the capitol city of france, then"), (7, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.distance, r.budget) for r in decontam.leaks(spark, docs, items).collect()}
    assert got == {(1, 1): (0, 0), (2, 2): (0, 0), (3, 3): (0, got[3, 3][1]), (5, 4): (0, 0), (6, 6): (1, 1)}
    assert sorted(r.doc_id for r in decontam.clean(docs, items).collect()) == [4, 7]


def test_places_of_short_items():
    assert decontam.Matcher([(1, "one")]).find("bone one none one") == [(1, 0, 0, 5, 8)]
