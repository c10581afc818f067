import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from inkwell.llm import decontam, langid, mixing, neardup, secrets  # noqa: E402
from inkwell.llm.workspace import Workspace  # noqa: E402

from .test_neardup import brute as components  # noqa: E402


def test_stages(spark, tiny):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "minhash_near_dedup", "benchmark_decontamination", "secret_scan", "source_mixing"]
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tiny).columns == docs.columns


def test_run_equals_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    model = langid.train(spark, docs)
    said = {r.doc_id: r for r in langid.identify(spark, docs, model).collect()}
    rows = {r.doc_id: r for r in docs.collect() if said[r.doc_id].lang_pred != "und"}
    reach = components([(i, r.text) for i, r in rows.items()])
    rows = {i: r for i, r in rows.items() if reach[i][1] == i}
    items = [(r.item_id, decontam.normalise(r.text)) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    leaked = {i for i, r in rows.items() for _, t in items if decontam.myers(t, decontam.bit_masks(t), decontam.normalise(r.text), int(len(t) * decontam.ERROR_RATE))}
    assert leaked
    left = []
    for i, r in rows.items():
        if i not in leaked:
            left.append((i, secrets.redact(r.text, [(a, b) for a, _, b, _ in secrets.find_spans(r.text)]), r.source))
    got = corpus_pipeline.run(spark, tiny).collect()
    assert {r.doc_id: (r.source, r["size"]) for r in got} == {i: (s, len(t.encode().split())) for i, t, s in left}
    mix = mixing.Mix(spark, spark.createDataFrame(left, "doc_id long, text string, source string"))
    places, times, want = {}, {}, {}
    for r in mix.slots.collect():
        times[r.sidx, r.block] = times.get((r.sidx, r.block), 0) + 1
    for r in mix.rows.collect():
        places[r.doc_id] = r.sidx, r.first
    for i, text, _ in left:
        sidx, first = places[i]
        want[i] = sum(times.get((sidx, (first + k) // mixing.BLOCK), 0) for k in range(len(text.encode().split())))
    assert {r.doc_id: r.taken for r in got} == want and sum(want.values()) > 0.9 * sum(r["size"] for r in got)


def test_secrets_leave_the_text(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = corpus_pipeline.secret_scan(spark, docs, small)
    assert out.count() == docs.count()
    assert all(r.n_chars == len(r.text) and all(k != 0 for _, k, _, _ in secrets.find_spans(r.text)) for r in out.collect())


def test_odd_rows(spark, odd, none, tiny):
    kept = corpus_pipeline.language_id(spark, odd, tiny)
    assert {r.doc_id for r in kept.collect()} <= {3, 4, 5, 6, None, 8}
    assert corpus_pipeline.near_dedup(spark, odd, tiny).where("doc_id = 3").count() == 1
    assert corpus_pipeline.decontamination(spark, odd, tiny).count() == 11
    assert corpus_pipeline.secret_scan(spark, odd, tiny).count() == 11
    assert corpus_pipeline.mix(spark, odd, tiny).count() == 11
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, tiny).count() == 0


def test_operators_used():
    assert {m.__name__.rsplit(".", 1)[1] for m in (decontam, langid, mixing, neardup, secrets)} and Workspace


def test_versions_of_an_id_stay_and_equal_rows_go(spark, tiny):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "en", "b", 3), (1, text, "en", "a", 3), (1, text, "en", "a", 3), (1, "another text altogether", "en", "a", 3), (2, text + " more", "en", "a", 3), (None, text, "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(corpus_pipeline.near_dedup(spark, docs, tiny).collect(), key=str)
    assert [tuple(r) for r in kept] == sorted([rows[1], rows[3], rows[5]], key=lambda r: str(spark.createDataFrame([r], docs.schema).first()))
