import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from inkwell.llm import langid
from inkwell.llm.sampling import smallest_keys


def test_held_out_accuracy(spark, small):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = langid.query(spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97


def test_lang_of_the_row_is_no_input(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(spark, docs)
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark, docs, model).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark, docs.selectExpr("doc_id", "text", "'xx' AS lang"), model).collect()}
    assert a == b


def test_odd_rows(spark, odd, none):
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in langid.identify(spark, odd).collect()), key=str)
    assert len(got) == 11
    assert {g[1:] for g in got if g[0] in (0, 1, 2, 7)} == {("und", 0.0)}
    assert all(g[1] in ("en", "fr", "de") for g in got if g[0] in (3, 4, 5, 8))
    assert langid.identify(spark, none).count() == 0
    untaught = langid.identify(spark, odd.selectExpr("doc_id", "text", "cast(null AS string) AS lang")).collect()
    assert {r.lang_pred for r in untaught} == {"und"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aÉ ñ1.漢\U0001f600\n", max_size=60), min_size=1, max_size=4))
def test_counts_do_not_depend_on_the_slices(texts):
    whole = [(i.tolist(), c.tolist(), x) for i, c, x in langid.rows_of(pa.array(texts))]
    for text, (ids, counts, lettered) in zip(texts, whole):
        grams = "".join(c.lower() if c.isalpha() else " " for c in text)
        assert sum(counts) <= 3 * len(grams) and lettered == any(c.isalpha() for c in text)
    before = langid.SLICE
    try:
        langid.SLICE = 7
        assert [(i.tolist(), c.tolist(), x) for i, c, x in langid.rows_of(pa.array(texts))] == whole
    finally:
        langid.SLICE = before
    assert np.all([sorted(w[0]) == w[0] for w in whole])


def test_ftrl_and_temperature_against_plain_loops():
    import math

    rng = np.random.default_rng(5)
    size, classes = 12, 3
    rows = [(int(rng.integers(classes)), np.sort(rng.choice(size, 4, replace=False)), rng.random(4)) for _ in range(60)]
    z, n = [[0.0] * classes for _ in range(size)], [[0.0] * classes for _ in range(size)]

    def w(i, k):
        if abs(z[i][k]) <= langid.L1:
            return 0.0
        return -(z[i][k] - math.copysign(langid.L1, z[i][k])) / ((langid.BETA + math.sqrt(n[i][k])) / langid.ALPHA + langid.L2)

    for _ in range(2):
        for y, ids, v in rows:
            now = {(i, k): w(i, k) for i in ids for k in range(classes)}
            score = [math.exp(sum(x * now[i, k] for i, x in zip(ids, v))) for k in range(classes)]
            for k in range(classes):
                for i, x in zip(ids, v):
                    g = x * (score[k] / sum(score) - (k == y))
                    sigma = (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / langid.ALPHA
                    z[i][k] += g - sigma * now[i, k]
                    n[i][k] += g * g
    assert np.allclose(langid.ftrl(rows, size, classes, 2), [[w(i, k) for k in range(classes)] for i in range(size)])

    logits, y = rng.normal(size=(400, 3)) * 4, rng.integers(3, size=400)
    logits[np.arange(400), y] += 3
    grid = np.exp(np.linspace(math.log(0.05), math.log(20), 2000))
    best = min(langid.log_loss(logits, y, t) for t in grid)
    assert langid.log_loss(logits, y, langid.temper(logits, y)) <= best + 1e-9


def test_the_sample_is_exact(spark):
    texts = [f"wort{i} eins zwei drei" for i in range(90)] + [f"word{i} one two three" for i in range(7)]
    usable = spark.createDataFrame([("de" if i < 90 else "en", t) for i, t in enumerate(texts) for _ in range(1 + 40 * (i == 3))], "lang string, text string").selectExpr("lang", "text", "xxhash64(text) AS key")
    every = {(r.lang, r.key) for r in usable.collect()}
    for sample in (1, 20, 1000):
        got = smallest_keys(spark, usable, "lang", sample).collect()
        want = {(lang, k) for lang in ("de", "en") for k in sorted((k for la, k in every if la == lang), key=lambda k: (k % (1 << 30), k))[:sample]}
        assert {(r.lang, r.key) for r in got} == want and len(got) == len(want)


def test_repeats_ties_and_single_rows(spark):
    schema = "doc_id long, text string, lang string"
    equal = spark.createDataFrame([(8, "ein einziger Text", "de")] * 2500, schema)
    assert {(r.lang_pred, r.score) for r in langid.identify(spark, equal).collect()} == {("de", 1.0)}
    two = spark.createDataFrame([(8, "the same words", "de"), (8, "the same words", "en")] * 30, schema)
    assert {r.lang_pred for r in langid.identify(spark, two).collect()} <= {"de", "en"}
    single = spark.createDataFrame([(i, f"{c * 9} {c * 5}", f"l{c}") for i, c in zip((1, 3, 6, 8, 10, 12, 13), "abcdefg")], schema)
    got = langid.identify(spark, single).collect()
    assert len(got) == 7 and all(r.lang_pred.startswith("l") and 0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == single.where(f"doc_id = {r.doc_id}").first().lang for r in got if not r.held_out)
