"""Header tree, component scores, gap report and audit renderings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X

MAX_LEVEL = 24
# fixed values: words that speak for a header
KEYWORDS = ("introduction", "summary", "scope", "background", "appendix", "results", "conclusion")


@dataclass(frozen=True)
class Weights:
    """Weights of the six components and the two decision thresholds."""

    regex: float = 1.0
    style: float = 1.0
    entropy: float = 0.8
    graph: float = 1.1
    fluid: float = 0.9
    llm_vote: float = 1.0
    header: float = 0.65
    subheader: float = 0.5

    def toml(self) -> str:
        """The tuned settings as a TOML text with three decimals."""
        names = ("regex", "style", "entropy", "graph", "fluid", "llm_vote")
        lines = ["[parser.efhg.weights]", *(f"{n} = {getattr(self, n):.3f}" for n in names), "", "[parser.efhg.thresholds]", f"header = {self.header:.3f}", f"subheader = {self.subheader:.3f}"]
        return "\n".join(lines) + "\n"


def schema_class(c: Column | str) -> Column:
    """numeric, appendix, letter_numeric or null."""
    s = X.strip(c)
    return F.when(s.rlike(r"^\d"), "numeric").when(s.rlike(r"(?iU)^appendix\s+[a-z]"), "appendix").when(s.rlike(r"^[A-Z]\d"), "letter_numeric")


def components(text: Column, level: Column, n_chunks: Column, w: Weights = Weights()) -> dict[str, Column]:
    """The six weighted components, rounded to three places, and their total."""
    schema, tokens = schema_class(text), X.word_count(text)
    letters, capitals = X.count_matches(text, r"(?U)[^\p{L}]"), X.count_matches(text, r"(?U)[^\p{Lu}]")
    parts = {
        "regex": F.when(schema.isNotNull(), 1.0).when(text.rlike(r"^\p{L}"), 0.45).otherwise(0.2),
        "style": F.least(F.lit(1.0), capitals / F.greatest(letters, F.lit(1)) * 0.45 + 0.55 + F.when(level == 1, 0.1).otherwise(0.0)),
        "entropy": F.greatest(F.lit(0.2), F.least(F.lit(1.0), 1.0 - F.least(tokens, F.lit(80)) / F.lit(120.0))),
        "graph": F.when(schema.isNotNull() & text.contains("."), 0.85).when(F.regexp_replace(text, r"(?U)\s+$", "").endswith(":"), 0.75).otherwise(0.65),
        "fluid": F.least(F.lit(1.0), F.when(tokens <= 12, 0.7).otherwise(0.5) + n_chunks * 0.05),
        "llm_vote": F.when(F.lower(text).rlike("|".join(KEYWORDS)), 0.85).otherwise(0.65),
    }
    out = {k: F.round(v * getattr(w, k), 3) for k, v in parts.items()}
    total = out["regex"]
    for k in list(out)[1:]:
        total = total + out[k]
    return out | {"total": F.round(total, 3)}


def decision(total: Column, w: Weights = Weights()) -> Column:
    return F.when(total < w.subheader, "reject").when(total < w.header, "promote.subheader").otherwise("promote.header")


def parents(headers: DataFrame, order: str = "n") -> DataFrame:
    """``headers`` plus parent: the number of the closest earlier header of a smaller level.

    One window with a running value per level up to MAX_LEVEL instead of a self-join; only headers deeper
    than that, which hardly any numbering reaches, are joined with each other.
    """
    level = F.col("level")
    w = Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = [F.when(level > k, F.last(F.when(level == k, F.col(order)), ignorenulls=True).over(w)) for k in range(1, MAX_LEVEL + 1)]
    deep = headers.where(level > MAX_LEVEL).select(F.col("doc_id").alias("deep_doc"), F.col(order).alias("deep_at"), F.col("level").alias("deep_level"))
    above = deep.selectExpr("deep_doc AS d", "deep_at AS above", "deep_level AS l")
    found = deep.join(above, (F.col("deep_doc") == F.col("d")) & (F.col("above") < F.col("deep_at")) & (F.col("l") < F.col("deep_level")))
    found = found.groupBy("deep_doc", "deep_at").agg(F.max("above").alias("above"))
    out = headers.withColumn("parent", F.greatest(*seen)).join(found, (F.col("doc_id") == F.col("deep_doc")) & (F.col(order) == F.col("deep_at")), "left")
    return out.withColumn("parent", F.greatest("parent", "above")).drop("deep_doc", "deep_at", "above")


def nodes(headers: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """Tree nodes of ``headers`` (doc_id, n, text, level, chunk_ids, recovered)."""
    text = X.strip("text")
    h = parents(headers.withColumn("text", text).withColumn("n_chunks", F.size("chunk_ids")))
    c = components(F.col("text"), F.col("level"), F.col("n_chunks"), weights)
    h = h.withColumns(c).withColumn("schema", schema_class("text"))
    key = F.col("doc_id").cast("string")
    node = lambda n: F.when(n.isNotNull(), F.concat(F.lit("header:"), key, F.lit(":"), n.cast("string")))
    return h.select(
        "doc_id", "n", node(F.col("n")).alias("node_id"), node(F.col("parent")).alias("parent_id"), "level", "text", F.lower("text").alias("text_norm"), *c, "schema",
        decision(F.col("total"), weights).alias("decision"), (F.col("n_chunks") > 1).alias("joined"), "chunk_ids", "recovered",
        F.when(F.col("recovered"), F.round(F.least(F.lit(1.0), F.col("total") / 2), 3)).alias("repair_confidence"),
    )


def with_roots(nodes_: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds a default root for documents without headers."""
    bare = docs.select("doc_id").join(nodes_.select("doc_id").distinct(), "doc_id", "left_anti")
    root = bare.select("doc_id", F.lit(0).alias("n"), F.concat(F.lit("header:"), F.col("doc_id").cast("string"), F.lit(":root")).alias("node_id"), F.lit(1).alias("level"), F.lit("Document").alias("text"), F.lit("document").alias("text_norm"), F.lit(0.0).alias("total"), F.lit("promote.header").alias("decision"), F.lit(False).alias("joined"))
    return nodes_.unionByName(root, allowMissingColumns=True)


def gaps(nodes_: DataFrame) -> DataFrame:
    """One row per recovered header: neighbours' texts, evidence and confidence."""
    w = Window.partitionBy("doc_id").orderBy("n")
    g = nodes_.withColumn("left", F.lag("text").over(w)).withColumn("right", F.lead("text").over(w)).where("recovered")
    schema = F.coalesce("schema", F.lit("numeric"))
    return g.select(
        "doc_id", "n", F.col("text").alias("expected"), schema.alias("schema"), "left", "right",
        F.round(F.least(F.size("chunk_ids"), F.lit(4)) * 0.05 + 0.7, 2).alias("style_sim"),
        F.when(schema != "numeric", 0.8).otherwise(0.7).alias("graph_adj"), F.lit(0).alias("page_distance"),
        F.round(F.least(F.lit(0.99), F.col("total") / 2.0), 2).alias("confidence"),
    )


def gap_report(nodes_: DataFrame) -> DataFrame:
    """doc_id, schemas, holes: schemas seen among recovered headers, numeric by default."""
    found = gaps(nodes_).groupBy("doc_id").agg(F.sort_array(F.collect_set("schema")).alias("schemas"), F.count("*").alias("holes"))
    return nodes_.select("doc_id").distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("schemas", F.array(F.lit("numeric"))).alias("schemas"), F.coalesce("holes", F.lit(0)).alias("holes"))


def _escape(c: Column) -> Column:
    # fixed values: the characters that markup reserves
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _listed(nodes_: DataFrame, line: Column) -> DataFrame:
    rows = nodes_.groupBy("doc_id").agg(F.count("*").alias("headers"), F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    holes = gaps(nodes_).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "expected", "confidence"))), lambda x: F.struct(x["expected"], x["confidence"])).alias("holes"))
    return rows.join(holes, "doc_id", "left").withColumn("holes", F.coalesce("holes", F.array().cast("array<struct<expected:string,confidence:double>>")))


def _level_text(text: Column) -> Column:
    return F.concat(F.lit("L"), F.col("level").cast("string"), F.lit(" "), text, F.lit(" (score="), F.col("total").cast("string"), F.lit(")"))


def audit_markdown(nodes_: DataFrame) -> DataFrame:
    """doc_id, value: the audit of a document's headers and repairs as Markdown."""
    rows = _listed(nodes_, F.concat(F.lit("- "), _level_text(F.col("text"))))
    repairs = F.transform("holes", lambda x: F.concat(F.lit("- "), x["expected"], F.lit(" :: confidence "), x["confidence"].cast("string")))
    head = F.array(F.concat(F.lit("# Parser Audit for "), F.col("doc_id").cast("string")), F.lit(""), F.concat(F.lit("Detected headers: "), F.col("headers").cast("string")), F.concat(F.lit("Recovered gaps: "), F.size("holes").cast("string")), F.lit(""), F.lit("## Headers"))
    tail = F.when(F.size("holes") > 0, F.concat(F.array(F.lit(""), F.lit("## Gap Repairs")), repairs)).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.concat(F.array_join(F.concat(head, F.col("lines"), tail), "\n"), F.lit("\n")).alias("value"))


def audit_html(nodes_: DataFrame) -> DataFrame:
    """doc_id, value: the same audit as escaped HTML."""
    rows = _listed(nodes_, F.concat(F.lit("<li>"), _level_text(_escape(F.col("text"))), F.lit("</li>")))
    repairs = F.array_join(F.transform("holes", lambda x: F.concat(F.lit("<li>"), _escape(x["expected"]), F.lit(" — confidence "), x["confidence"].cast("string"), F.lit("</li>"))), "")
    title = F.concat(F.lit("Parser Audit for "), _escape(F.col("doc_id").cast("string")))
    tail = F.when(F.size("holes") > 0, F.concat(F.lit("<section><h2>Gap Repairs</h2><ul>"), repairs, F.lit("</ul></section>"))).otherwise("")
    return rows.select("doc_id", F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head><body><h1>"), title, F.lit("</h1><section><h2>Detected Headers</h2><ul>"), F.array_join("lines", ""), F.lit("</ul></section>"), tail, F.lit("</body></html>")).alias("value"))


def junit(nodes_: DataFrame) -> DataFrame:
    """doc_id, value: a JUnit suite with a passing case per header."""
    rows = _listed(nodes_, F.concat(F.lit('    <testcase classname="headers" name="'), _escape(F.col("text")), F.lit('" time="0"/>')))
    head = F.concat(F.lit('<testsuite name="parser" tests="'), F.col("headers").cast("string"), F.lit('" failures="0">'))
    return rows.select("doc_id", F.concat(F.array_join(F.concat(F.array(head), F.col("lines"), F.array(F.lit("</testsuite>"))), "\n"), F.lit("\n")).alias("value"))
