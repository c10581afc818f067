import json

from pyspark.sql import functions as F, types as T

from inkwell.sources import files
from inkwell.streaming import ingest as stream


def test_payloads_texts_and_manifests(spark, tmp_path):
    folder = tmp_path / "doc1"
    folder.mkdir()
    (folder / "a.txt").write_bytes("café".encode())
    (folder / "b.txt").write_bytes("café".encode("latin-1"))
    (folder / "c.txt").write_bytes(b"")
    found = files.payloads(spark, f"file://{tmp_path}")
    assert {r.path.rsplit("/", 1)[1]: r.size_bytes for r in found.collect()} == {"a.txt": 5, "b.txt": 4}
    ok = files.within_limit(found, 10)
    assert {r.text for r in files.texts(ok).collect()} == {"café"}
    m = files.manifests(found, "raw").where("size = 5").first()
    assert (m.doc_id, m.kind, len(m.checksum)) == ("doc1", "raw", 64)


def test_json_and_jsonl(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n\nnot json\n{"a": 2}\n')
    assert sorted((r.a, r.b) for r in files.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", schema).collect()) == [(1, "x"), (2, None)]
    assert files.read_jsonl(spark, f"file://{tmp_path}/none", schema).count() == 0
    (tmp_path / "y.json").write_text(json.dumps({"a": 3, "b": "y"}, indent=2))
    assert files.read_json(spark, f"file://{tmp_path}/y.json", schema).first().a == 3
    df = files.inline_texts(spark, [("d", "t")])
    files.write_jsonl(df, f"file://{tmp_path}/out", "doc_id")
    assert spark.read.json(f"file://{tmp_path}/out").first().text == "t"
    files.write_texts(df.select("doc_id", F.col("text").alias("value")), f"file://{tmp_path}/txt")
    assert spark.read.text(f"file://{tmp_path}/txt").first().value == "t"


def test_incremental_ingest(spark, tmp_path):
    source, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()

    def run(name, rows):
        (tmp_path / "in" / name).write_text("".join(json.dumps(dict(doc_id=i, text=t, uploaded_at="2024-01-01T00:00:00Z")) + "\n" for i, t in rows))
        stream.to_table(stream.first_seen(stream.uploads(spark, source)), out, mark).awaitTermination(60)
        return sorted(r.text for r in spark.read.parquet(out).collect())

    assert run("1.json", [("a", "x"), ("b", "x"), ("c", "y")]) == ["x", "y"]
    assert run("2.json", [("d", "x"), ("e", "z")]) == ["x", "y", "z"]


def test_windowed_counts(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    batch = stream.event_counts(events).groupBy().sum("n").first()[0]
    assert batch == events.count()
