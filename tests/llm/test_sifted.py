"""Texts of few documents are fetched without sending the others through a shuffle."""

from pyspark.sql import functions as F

from inkwell.llm import neardup, substring, workspace


def test_sieve_keeps_what_is_wanted_and_little_else(spark):
    docs = spark.range(200_000).select((F.col("id") * 7919 - 700_000_000).alias("doc_id"), F.lit("t").alias("text")).unionAll(spark.sql("select cast(null as long), 't'"))
    wanted = docs.where("doc_id % 40 = 0").select("doc_id")
    got = workspace.sifted(docs, wanted, "doc_id").select("doc_id")
    assert wanted.exceptAll(got).count() == 0 and got.where("doc_id is null").count() == 0
    assert got.count() < 0.12 * docs.count()
    assert workspace.sifted(docs, wanted.where("false"), "doc_id").count() == 0


def test_texts_shuffle_only_wanted_documents(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs, old = docs.unionAll(docs.where("doc_id < 100")).unionAll(spark.sql("select 20L, 'other version'")), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for many wanted ids
    try:
        ws = workspace.Workspace(spark, "test")
        wanted = ws.save(docs.where("doc_id % 20 = 0").select("doc_id").distinct())
        before = _shuffled(spark)
        got = neardup._texts(ws, docs, wanted)
        assert _shuffled(spark) - before < 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = {(i, f"text {i}") for i in range(0, 3000, 20)} | {(20, "other version")}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def _shuffled(spark):
    """Records that the session's stages have written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_levels_shuffle_only_documents_with_repeats(spark):
    """Two documents share 230 words; the others go through no shuffle of the levels after the first."""
    alone = spark.range(2000).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 60), i -> concat(id, '-', i)), ' ')").alias("text"))
    same = spark.range(2).select((F.col("id") + 5000).alias("doc_id"), F.expr("array_join(transform(sequence(1, 230), i -> concat('s', i)), ' ')").alias("text"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for many documents with repeats
    try:
        ws = workspace.Workspace(spark, "test")
        docs, written = ws.save(alone.unionAll(same)), []
        for length, found in substring.levels(ws, docs):
            assert {r.doc_id for r in found.select("doc_id").collect()} <= {5000, 5001}
            written.append((length, _shuffled(spark)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert [length for length, _ in written] == [50, 100, 200]
    assert written[-1][1] - written[0][1] < 2000
