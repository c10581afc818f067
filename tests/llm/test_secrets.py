import hashlib
import re

from inkwell.llm import secrets
from inkwell.llm.workspace import Workspace

HEAD = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in HEAD.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    out.sort()
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in out)
    return (*(sum(x[1] == k for x in out) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest())


def test_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.query(spark, small).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs}
    assert sum(x[0] + x[1] + x[2] for x in got.values()) > 10


def test_patterns():
    for text in ('é API_KEY = "abc_def.12"', "token: short token:'longenough'", "PASSWORD==x9x9x9", "ſecret=abcdefgh", "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 16, "0" * 23 + "g" + "a" * 24, 'apikey"="deadbeef00deadbeef00deadbeef'):
        base = [(a, k, b) for a, k, b, _ in secrets.find_spans(text)]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert hashlib.sha256(joined.encode()).hexdigest() == brute(text)[3]


def test_ledger_scans_only_unseen_pairs(spark):
    scanned = []
    path = Workspace(spark, "ledger").path("ledger")
    v1 = spark.createDataFrame([("a", "token=abcdef1"), ("b", "token=abcdef1"), ("c", None)], "path string, text string")
    v2 = spark.createDataFrame([("a", "token=abcdef1"), ("d", "AKIA" + "Z" * 16)], "path string, text string")
    first = {r.path: len(r.findings) for r in secrets.scan_versions(spark, v1, path).collect()}
    assert first == {"a": 1, "b": 1, "c": 0} and spark.read.parquet(path).count() == 2
    second = {r.path: len(r.findings) for r in secrets.scan_versions(spark, v2, path).collect()}
    assert second == {"a": 1, "d": 1} and spark.read.parquet(path).count() == 3
    newer = (*secrets.RULES[:-1], secrets.Rule("pem", 2, lambda t: [], base=False))
    secrets.scan_versions(spark, v2, path, newer).collect()
    rows = spark.read.parquet(path).where("size(rules) = 1").collect()
    assert len(rows) == 2 and all(r.rules == ["pem@2"] for r in rows)
    secrets.scan_versions(spark, v2, path, newer).collect()
    assert spark.read.parquet(path).count() == 5 and not scanned


def test_odd_rows_and_redaction(spark, odd, none):
    found = secrets.digest(secrets.scan_versions(spark, odd.selectExpr("doc_id AS path", "text"), Workspace(spark, "l").path("l")))
    assert found.count() == 11 and found.where("n_assign + n_access + n_hex > 0").count() == 0
    assert secrets.digest(secrets.scan_versions(spark, none.selectExpr("doc_id AS path", "text"), Workspace(spark, "l").path("l"))).count() == 0
    docs = spark.createDataFrame([(1, "x token=abcdef1 y", "k"), (2, None, "k"), (1, "clean", "k"), (None, "token=abcdef1", "k")], "doc_id long, text string, path string")
    texts = sorted(str(r.text) for r in secrets.redacted(spark, docs, Workspace(spark, "l").path("l")).collect())
    assert texts == ["None", "[SECRET]", "clean", "x [SECRET] y"]
    assert secrets.redact("abcdefgh", [(1, 4), (3, 6)], "*") == "a*gh"


def test_a_second_run_of_the_query_scans_nothing(spark, tiny):
    plain = sorted(map(str, secrets.query(spark, tiny).collect()))
    path = Workspace(spark, "kept").path("ledger")
    spark.conf.set(secrets.SETTING, path)
    try:
        first = sorted(map(str, secrets.query(spark, tiny).collect()))
        entries = spark.read.parquet(path).count()
        blobs = spark.read.parquet(f"{tiny}/documents.parquet").selectExpr("coalesce(text, '') AS text").distinct().count()
        second = sorted(map(str, secrets.query(spark, tiny).collect()))
        assert spark.read.parquet(path).count() == entries == blobs and first == second == plain
    finally:
        spark.conf.unset(secrets.SETTING)
