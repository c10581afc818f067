import pytest
from pyspark.sql import functions as F

from inkwell.functions import providers
from inkwell.operators import catalog
from inkwell.plans import pipeline
from inkwell.sources import pdf

from .test_operators import TEXT


def test_whole_pipeline(spark, tmp_path):
    docs = spark.createDataFrame([(1, TEXT + "\n\n2. Motors are rated\n\n2.1 Loads on shafts and seals.\n\nChapter 3 Controls"), (2, "nothing to see here, it goes on"), (3, "")], "doc_id long, text string")
    made = pipeline.run(spark, docs, f"file://{tmp_path}/out", pipeline.Settings(target_tokens=22, overlap=6))
    assert made["chunks"].where("doc_id = 1").count() >= 2
    found = [r.text for r in made["headers"].where("doc_id = 1").orderBy("n").collect()]
    assert any(t.startswith("Appendix A") for t in found) and any(t.startswith("2. Motors") for t in found)
    chunks = made["chunks"].join(made["headers"].select("doc_id").distinct(), "doc_id", "left_semi").count()
    assert made["section_map"].count() == chunks and made["tree"].count() == made["headers"].count()
    docs_with_headers = made["headers"].select("doc_id").distinct().count()
    assert made["passes"].count() == 5 * docs_with_headers and made["pass_manifest"].count() == docs_with_headers
    assert made["audit"].where("status = 'ok'").count() == 18


def test_pdf_cascade(spark):
    def broken(data):
        raise ValueError

    def empty(data):
        return iter(())

    def fake(data):
        yield 1, 0.5, data.decode(), (0, 1, 2, 3), "Arial", 12.0, "normal", "normal", 1.0

    assert pdf.cascade(b"x", [("a", broken), ("c", fake), ("b", empty)])[0] == "c"
    assert pdf.cascade(b"x", [("a", broken), ("b", empty), ("c", fake)]) == ("b", [])  # it did not fail
    assert pdf.cascade(b"[image:x] \n\n\n", [("a", broken)]) == ("text", [])
    files = spark.createDataFrame([("0123456789abcdef", bytearray(b"hello\n\nyou\fcaf\xe9 [Image: b]")), ("fedcba9876543210", bytearray(b""))], "sha256 string, content binary")
    rows = sorted(pdf.extract(files, []).collect(), key=str)
    assert [(r.doc_id, r.extractor, r.n_pages, r.page_number, r.block_no, r.text, r.confidence) for r in rows] == [
        ("0123456789ab", "text", 2, 1, 1, "hello", 0.8), ("0123456789ab", "text", 2, 1, 2, "you", 0.8), ("0123456789ab", "text", 2, 2, 1, "café", 0.8), ("fedcba987654", "text", 0, None, None, None, None),
    ]


def test_retries_and_breaker():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert providers.with_retries(flaky, providers.Retry(4, 1.0), sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    now = [0.0]
    b = providers.Breaker(limit=2, cool_down=10, clock=lambda: now[0])
    for _ in range(2):
        with pytest.raises(OSError):
            b.call(lambda: (_ for _ in ()).throw(OSError()))
    with pytest.raises(RuntimeError):
        b.call(lambda: 1)
    now[0] = 11
    assert b.call(lambda: 1) == 1


def test_embedding_column(spark):
    class Lengths:
        dimension = 1

        def embed(self, texts):
            return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([("ab",), (None,)], "t string")
    assert sorted(r.v[0] for r in df.select(providers.embedding(Lengths)("t").alias("v")).collect()) == [0.0, 2.0]


def test_catalog(spark, tmp_path):
    files = spark.createDataFrame([("a/x.pdf", bytearray(b"%PDF-1"))], "path string, content binary")
    assert catalog.save_source(files, f"file://{tmp_path}/store").first().size_bytes == 6
    r = spark.createDataFrame([("d", 1, {"chunks": "p", "odd": "q", "tree": None})], "doc_id string, updated_at int, artifacts map<string,string>")
    assert catalog.visible(r).first().artifacts == {"chunks": "p"}
    paths = spark.createDataFrame([("r/a",), ("r/../b",), ("s/a",)], "path string")
    assert [x.path for x in catalog.inside(paths, "r").collect()] == ["r/a"]
    asked = spark.createDataFrame([("d",), ("e",)], "doc_id string")
    assert {x.doc_id: x.updated_at for x in catalog.status(r, asked).collect()} == {"d": 1, "e": None}
    chunks = spark.createDataFrame([(1, "a"), (1, None)], "doc_id long, text string")
    assert tuple(catalog.index_manifest(chunks).first()) == (1, 2, 1)
    assert catalog.audit_row(spark, "s", "parse", "ok", 0.5, note=None, n=3).select(F.col("extra")).first().extra == {"n": "3"}
