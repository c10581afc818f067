"""Secret scanning with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text.  The ledger is an append-only
Parquet table of (blob, the rule versions it was scanned with, findings).  A run

1. addresses all versions and keeps one location per distinct blob,
2. subtracts the (blob, rule version) pairs the ledger holds already,
3. scans only the remaining blobs, each with the rules it still lacks, and appends the result,
4. joins the findings back to every path that holds the blob.

Of the ledger only the entries of the run's own blobs are aggregated.  Its folder is a parameter; the query
and the pipeline take it from the session setting ``spark.inkwell.ledger``.  There it is kept, so that a
later run scans only what is new.  Without the setting a run has a ledger of its own, which goes with the
process.

A hot blob is one row up to the last join, which is on a written table so that adaptive execution
can split it.  A run that dies before its append is repeated whole; an entry appended twice reads
as one, because findings are a set.

Findings are (kind, start, end) in code points, end exclusive.  Besides the base kinds ``assign``,
``access`` and ``hex``, rule ``pem`` adds private keys in PEM form, from the BEGIN line to
the END line; where END is missing before the next key, to the end of the base64 run.

Edge cases: null text is the empty blob; repeated rows and null ids are answered row by row; an
empty table gives an empty result; other columns are ignored; texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .workspace import Workspace, released, spread

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----")
_GAP = r"(?:[\s\"'+,>#*|]|\\[nrt])*+"  # between the lines of a key, also as a literal or a quotation
_PEM_BODY = re.compile(rf"(?:{_GAP}(?:Proc-Type|DEK-Info|Version|Comment): [^\r\n\\]*)*+(?:{_GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}})*+(?:{_GAP}(?:[A-Za-z0-9+/]{{1,15}}={{1,2}}|(?<=[\r\n])[A-Za-z0-9+/]{{1,15}}(?=[\r\n]|\Z)))?")
SETTING = "spark.inkwell.ledger"
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _assign(text: str) -> list[tuple[int, int]]:
    low = text.lower()
    if not any(w in low for w in _WORDS):
        return []
    return [m.span() for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]


def _access(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ACCESS.finditer(text)] if "AKIA" in text else []


def _hex(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _HEX.finditer(text)]


def _pem(text: str) -> list[tuple[int, int]]:
    if "PRIVATE KEY-----" not in text:
        return []
    heads = [m.span() for m in _PEM.finditer(text)]
    out = []
    for (a, b), limit in zip(heads, [x for x, _ in heads[1:]] + [len(text)]):
        end = _PEM_END.search(text, b, limit) or _PEM_BODY.match(text, b, limit)
        out.append((a, end.end()))
    return out


@dataclass(frozen=True)
class Rule:
    """``version`` changes whenever ``find`` could give other spans."""

    kind: str
    version: int
    find: Callable[[str], list[tuple[int, int]]]
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (Rule("assign", 1, _assign), Rule("access", 1, _access), Rule("hex", 1, _hex), Rule("pem", 3, _pem, base=False))

FINDINGS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("rule", T.StringType())]))
LEDGER = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("rules", T.ArrayType(T.StringType())), T.StructField("findings", FINDINGS)])
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("rule", pa.string())]))


def find_spans(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int, str]]:
    """(start, rank of the rule, end, rule key), sorted."""
    return sorted((a, k, b, r.key) for k, r in enumerate(rules) for a, b in r.find(text))


def _scanner(rules: tuple[Rule, ...]):
    rank = {r.key: k for k, r in enumerate(rules)}

    @released
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, wanted in zip(batch.column("text"), batch.column("rules").to_pylist()):
                text = text.as_py() or ""
                found.append([dict(start=a, rank=rank[r.key], end=b, rule=r.key) for r in rules if r.key in wanted for a, b in r.find(text)])
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("rules"), pa.array(found, _ARROW)], names=["blob", "rules", "findings"])

    return scan


def ledger_folder(spark: SparkSession) -> str:
    """The folder that the session names, or a new one."""
    return spark.conf.get(SETTING, None) or Workspace(spark, "ledger").path("ledger")


def _read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    exists = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(LEDGER).parquet(path) if exists else None


def scan_versions(spark: SparkSession, versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, findings) for each row of ``versions`` (path, text); the ledger gains what was unseen."""
    ws = Workspace(spark, "secrets")
    keys = [r.key for r in rules]
    blobs = versions.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    places = ws.save(blobs.select("path", "blob"), "places")
    own = todo = ws.save(places.groupBy("blob").agg(F.min("path").alias("path")).withColumn("rules", F.lit(keys)), "blobs")
    ledger = _read_ledger(spark, ledger_path)
    if ledger is not None:
        seen = ledger.join(todo.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
        todo = todo.join(seen, "blob", "left").select("blob", "path", F.array_except("rules", F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")).where("size(rules) > 0")
        todo = ws.save(todo, "todo")
    todo = todo.withColumnsRenamed({"blob": "todo_blob", "path": "todo_path"})
    located = blobs.join(todo, (F.col("blob") == F.col("todo_blob")) & F.col("path").eqNullSafe(F.col("todo_path")))
    located.select("blob", "rules", "text").mapInArrow(_scanner(rules), LEDGER).write.mode("append").parquet(ledger_path)

    entries = spark.read.schema(LEDGER).parquet(ledger_path)
    if ledger is not None:  # else all of it is this run's
        entries = entries.join(own.select("blob"), "blob", "left_semi")
    entries = entries.groupBy("blob").agg(F.flatten(F.collect_set("findings")).alias("findings"))
    active = F.sort_array(F.array_distinct(F.filter("findings", lambda x: x["rule"].isin(keys))))
    entries = ws.save(entries.select("blob", active.alias("findings")), "entries")
    return places.join(entries, "blob", "left").select("path", "blob", "findings")


def _joined(findings, rules: tuple[Rule, ...]):
    kind = F.create_map(*[F.lit(x) for r in rules for x in (r.key, r.kind)])
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", kind[x["rule"]], x["start"], x["end"])), ",")


def digest(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The per-document columns of a result of ``scan_versions``."""
    base = F.filter("findings", lambda x: x["rule"].isin([r.key for r in rules if r.base]))

    def count(rule: Rule):
        return F.size(F.filter("findings", lambda x: x["rule"] == rule.key)).cast("long").alias(f"n_{rule.kind}")

    counts = [count(r) for r in rules if r.base]
    return findings.select(F.col("path").alias("doc_id"), *counts, F.sha2(_joined(base, rules), 256).alias("base_sha256"), _joined(F.col("findings"), rules).alias("spans"))


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with the union of the spans replaced by ``mark``."""
    out, last = [], 0
    for a, b in sorted(spans):
        if a >= last:
            out += [text[last:a], mark]
        last = max(last, b)
    return "".join(out) + text[last:]


@released
def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t if t is None or not f else redact(t, [(x["start"], x["end"]) for x in f]) for t, f in zip(batch.column("text").to_pylist(), batch.column("findings").to_pylist())]
        out = batch.drop_columns(["findings"])
        yield out.set_column(out.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def redacted(spark: SparkSession, docs: DataFrame, ledger_path: str, key: str = "doc_id") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by a mark; rows that share a key are told apart by their blob."""
    found = scan_versions(spark, docs.select(F.col(key).alias("path"), "text"), ledger_path).where("size(findings) > 0").dropDuplicates(["path", "blob"])
    same = docs[key].eqNullSafe(found["path"]) & (F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256)) == found["blob"])
    return docs.join(found, same, "left").select(*[docs[c] for c in docs.columns], "findings").mapInArrow(_redact, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return digest(scan_versions(spark, docs.select(F.col("doc_id").alias("path"), "text"), ledger_folder(spark)))
