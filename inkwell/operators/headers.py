"""Section headers: detection in chunks, scoring, stitching, de-duplication and repair of series."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import text as X

# fixed values: patterns of header text and their scores
PATTERNS = [
    (r"(?iU)^(?:appendix|chapter|section)\s+[A-Z\d]+(?:[\.\-][A-Z\d]+)*(?:\b|\s|:)", 0.9),
    (r"(?U)^\d+(?:\.\d+)+\s+", 0.85),
    (r"(?U)^\d+[\.)]\s+", 0.72),
    (r"(?iU)^[A-Z]\d+(?:[\.\-]\d+)*\b", 0.75),
    (r"(?iU)^(?:[IVXLCM]+\.)+\s+", 0.7),
    (r"(?iU)^(executive summary|introduction|overview|conclusion)\b", 0.62),
    (r"(?U)^[A-Z][A-Z\s]{4,}$", 0.65),
]
# fixed values: words and units
KEYWORDS = ("appendix", "chapter", "section")
UNITS = "hz khz mhz ghz db dba dbm vac vdc amp amps a v kv mw kw hp lb lbs kg g mm cm m in ft psi scfm rpm % °c °f".split()
# fixed values: headers inside running text, and where a header starts
INLINE = [
    r"(?:appendix|chapter|section)\s+[A-Z\d]+(?:[\.\-][A-Z\d]+)*(?:\s+[A-Z][^\.\n;:]{0,60})?",
    r"[A-Z]?\d+(?:\.\d+)*(?:[\.)])?\s+[A-Z][^\.\n;:]{0,60}",
]
START = r"(?:appendix|chapter|section)\s+[A-Z\d]+(?:[\.\-][A-Z\d]+)*|[A-Z]?\d+(?:\.\d+)*(?:[\.)])?(?=\s+[A-Z])"
INLINE_MIN, WHOLE_MIN = 0.35, 0.25
STRONG, WEAK = 0.55, 0.35


def base_score(c: Column | str) -> Column:
    """The best of the patterns' scores, capitals and a final colon; a little more for up to six words."""
    s = X.strip(c)
    letters = X.count_matches(s, r"(?U)[^\p{L}]")
    capitals = X.count_matches(s, r"(?U)[^\p{Lu}]")
    tests = [(s.rlike(p), v) for p, v in PATTERNS] + [((letters > 0) & (capitals / F.greatest(letters, F.lit(1)) >= 0.65), 0.55), (s.endswith(":"), 0.6)]
    best = F.greatest(*[F.when(t, F.lit(v)).otherwise(0.0) for t, v in tests])
    return F.least(best + F.when(X.word_count(s) <= 6, F.lit(0.05)).otherwise(0.0), F.lit(0.95))


def series_key(c: Column | str) -> Column:
    """struct(key, ordinal, level): what series a header belongs to and its place there."""
    s = F.regexp_replace(X.strip(c), r"(?U)\s+", " ")
    numbers = lambda x: F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1))
    last = lambda a: F.try_element_at(a, F.lit(-1)).cast("long")
    labelled = r"(?iU)^(appendix|chapter|section)\s+([A-Z\d]+(?:[\.\-][A-Z\d]+)*)"
    body = F.regexp_extract(s, labelled, 2)
    dotted = F.regexp_extract(s, r"^(\d+(?:\.\d+)*)", 1)
    lettered = F.regexp_extract(s, r"^([A-Z](?:[\.\-]\d+)+)", 1)
    roman = F.regexp_extract(s, r"(?i)^([IVXLCM]+)\.", 1)
    slug = F.regexp_replace(F.regexp_replace(F.upper(s), "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")

    def out(key: Column, found: Column | None) -> Column:
        ordinal = F.lit(None).cast("long") if found is None else last(found)
        level = F.lit(1) if found is None else F.greatest(F.size(found), F.lit(1))
        return F.struct(key.alias("key"), ordinal.alias("ordinal"), level.alias("level"))

    return (
        F.when(s == "", out(F.lit("root"), None))
        .when(body != "", out(F.concat(F.initcap(F.regexp_extract(s, labelled, 1)), F.lit(" "), F.upper(body)), numbers(body)))
        .when(dotted != "", out(dotted, numbers(dotted)))
        .when(lettered != "", out(F.upper(lettered), numbers(lettered)))
        .when(roman != "", out(F.upper(roman), None))
        .otherwise(out(F.when(slug == "", F.lit("root")).otherwise(slug), None))
    )


def viable(c: Column | str) -> Column:
    """At least three characters, a real word or keyword, and no measurement."""
    s = X.strip(c)
    found = F.regexp_extract_all(s, F.lit("([A-Za-z]+)"), F.lit(1))
    word = F.exists(found, lambda w: ((F.length(w) >= 3) & w.rlike("[a-z]")) | F.lower(w).isin(*KEYWORDS))
    t = F.regexp_replace(X.strip(F.lower(s)), "^[.:;)]+|[.:;)]+$", "")
    unit = F.regexp_extract(t, r"(?U)^[\d\s.,/\-]+([a-z°%]+)$", 1)
    parts = X.words(t)
    number = F.regexp_replace(F.get(parts, F.lit(0)), ",", "").rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?$")
    second = F.regexp_replace(F.get(parts, F.lit(1)), "^[()%]+|[()%]+$", "")
    measure = unit.isin(*UNITS) | ((F.size(parts) == 2) & number & second.isin(*UNITS))
    return (F.char_length(s) >= 3) & word & ~F.coalesce(measure, F.lit(False))


def trim_header(c: Column | str) -> Column:
    """The first two to four words, by how the header starts; lone dashes go."""
    parts = F.filter(X.words(c), lambda w: ~w.isin("-", "–"))
    first = F.get(parts, F.lit(0))
    limit = F.when(F.lower(first).isin(*KEYWORDS), 3).when(first.rlike(r"(?U)^[A-Z]?\d"), 2).otherwise(4)
    return F.when(F.size(parts) == 0, X.strip(c)).otherwise(F.array_join(F.slice(parts, F.lit(1), limit), " "))


_FINDERS = [re.compile(p, re.IGNORECASE) for p in INLINE]
_STARTS = re.compile(START, re.IGNORECASE)


def inline_pieces(text: str) -> list[tuple[int, str]]:
    """(offset, raw header) of every header-like stretch, cut where another header starts inside it."""
    out = []
    for finder in _FINDERS:
        for m in finder.finditer(text):
            starts = [s.start() for s in _STARTS.finditer(m[0])] or [0]
            for a, b in zip(starts, [*starts[1:], len(m[0])]):
                out.append((m.start() + a, m[0][a:b].strip().strip(" .:-)\n")))
    return out


_PIECES = T.ArrayType(T.StructType([T.StructField("offset", T.IntegerType()), T.StructField("raw", T.StringType())]))


@F.pandas_udf(_PIECES)
def _inline(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"offset": a, "raw": r} for a, r in inline_pieces(t)] if t else [] for t in texts])


def candidates(chunks: DataFrame) -> DataFrame:
    """Header candidates of ``chunks`` (doc_id, chunk_id, chunk_index, text, sentence_start, sentence_end).

    A chunk with inline headers gives those that score INLINE_MIN, at 100 * index + place; any other
    viable chunk is a candidate itself from WHOLE_MIN on.
    """
    text = F.regexp_replace(X.strip("text"), "–", "-")
    c = chunks.withColumn("flat", text).where(F.col("flat") != "").withColumn("found", _inline("flat"))
    c = c.withColumn("found", F.transform("found", lambda x: F.struct(x["offset"].alias("offset"), trim_header(x["raw"]).alias("header"))))
    c = c.withColumn("found", F.filter("found", lambda x: (x["header"] != "") & viable(x["header"])))
    # one of equal (offset, lower-case text), in order of offset; the finders' order breaks ties
    first = lambda x, i: F.size(F.filter(F.slice(F.col("found"), F.lit(1), i), lambda y: (y["offset"] == x["offset"]) & (F.lower(y["header"]) == F.lower(x["header"])))) == 0
    c = c.withColumn("found", F.filter("found", first))
    order = F.transform(F.array_sort(F.transform("found", lambda x, i: F.struct(x["offset"], i.alias("i"), x["header"].alias("header")))), lambda x: x["header"])
    inline = c.where(F.size("found") > 0).select("doc_id", "chunk_id", "chunk_index", "sentence_start", F.posexplode(order).alias("i", "header"))
    inline = inline.withColumn("at", F.col("i") + 1).select(
        "doc_id", "chunk_id", (F.col("chunk_index") * 100 + F.col("at")).alias("chunk_index"), F.col("header").alias("text"), (F.col("sentence_start") + F.col("at")).alias("sentence_start"), (F.col("sentence_start") + F.col("at")).alias("sentence_end"), F.lit(INLINE_MIN).alias("least")
    )
    whole = c.where((F.size("found") == 0) & viable("flat")).select("doc_id", "chunk_id", "chunk_index", F.col("flat").alias("text"), "sentence_start", "sentence_end", F.lit(WHOLE_MIN).alias("least"))
    out = inline.unionByName(whole).withColumn("score", base_score("text")).where(F.col("score") >= F.col("least"))
    return out.withColumn("k", series_key("text")).select("doc_id", "chunk_id", "chunk_index", "text", "score", F.col("k.key").alias("section_key"), F.col("k.ordinal").alias("ordinal"), F.col("k.level").alias("level"), "sentence_start", "sentence_end", F.lit(False).alias("recovered"))


def typography_boost(score: Column, size: Column, weight: Column) -> tuple[Column, Column]:
    """(score with boost, boost) from mean type size and weight."""
    size, weight = F.coalesce(size, F.lit(0.0)), F.coalesce(weight, F.lit(0.0))
    boost = F.when(size >= 16, 0.2).when(size >= 13, 0.1).otherwise(0.0) + F.when(weight >= 600, 0.1).otherwise(0.0) + F.when((score >= 0.75) & (size >= 14), 0.05).otherwise(0.0)
    return F.when(boost > 0, F.least(score + boost, F.lit(1.0))).otherwise(score), boost


_ROW = "struct<chunk_index:bigint,section_key:string,ordinal:bigint,text:string,score:double,level:int,sentence_start:bigint,sentence_end:bigint,recovered:boolean,chunk_ids:array<string>>"


def stitch(headers: DataFrame) -> DataFrame:
    """Merges fragments of one header in consecutive chunks, per document.

    A fragment joins the row before if series and ordinal agree, its index is one more, and it is
    at most 40 characters or the row's merged text ends in a dash or colon.  The last test depends
    on merges so far, hence a fold; it runs over each stretch of consecutive chunks with one series and
    ordinal, which a window finds, and not over the document.
    """
    cols = ["chunk_index", "section_key", "ordinal", "text", "score", "level", "sentence_start", "sentence_end", "recovered"]
    row = F.struct(*[F.col(c).cast(t).alias(c) for c, t in zip(cols, ("long", "string", "long", "string", "double", "int", "long", "long", "boolean"))], F.when(F.col("chunk_id").isNotNull(), F.array("chunk_id")).otherwise(F.array().cast("array<string>")).alias("chunk_ids"))
    trim = lambda c: F.regexp_replace(c, "^[ \\-:\n]+|[ \\-:\n]+$", "")

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        same = last["section_key"].eqNullSafe(x["section_key"]) & last["ordinal"].eqNullSafe(x["ordinal"]) & (x["chunk_index"] == last["chunk_index"] + 1)
        joins = same & ((F.char_length(x["text"]) <= 40) | X.strip(last["text"]).rlike("[-–:]$"))
        text = X.strip(F.array_join(F.transform(F.filter(F.array(last["text"], x["text"]), lambda t: t != ""), trim), " "))
        merged = F.struct(
            F.greatest(last["chunk_index"], x["chunk_index"]).alias("chunk_index"), last["section_key"].alias("section_key"), last["ordinal"].alias("ordinal"), text.alias("text"),
            F.greatest(last["score"], x["score"]).alias("score"), last["level"].alias("level"), last["sentence_start"].alias("sentence_start"), F.greatest(last["sentence_end"], x["sentence_end"]).alias("sentence_end"),
            last["recovered"].alias("recovered"), F.concat(last["chunk_ids"], x["chunk_ids"]).alias("chunk_ids"),
        )
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(done, F.array(x)))

    w = Window.partitionBy("doc_id").orderBy("row")
    last, x = F.lag("row").over(w), F.col("row")
    goes_on = last["section_key"].eqNullSafe(x["section_key"]) & last["ordinal"].eqNullSafe(x["ordinal"]) & (x["chunk_index"] == last["chunk_index"] + 1)
    marked = headers.select("doc_id", row.alias("row")).withColumn("begins", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("stretch", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = marked.groupBy("doc_id", "stretch").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    folded = rows.select("doc_id", F.explode(F.aggregate("rows", F.array().cast(f"array<{_ROW}>"), step)).alias("r"))
    return folded.select("doc_id", "r.*")


def dedupe(headers: DataFrame, group: tuple[str, ...] = ("doc_id", "section_key", "ordinal")) -> DataFrame:
    """The best score of each (section key, ordinal); the later chunk wins ties."""
    w = Window.partitionBy(*group).orderBy(F.desc("score"), F.desc("chunk_index"))
    return headers.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def repair(headers: DataFrame) -> DataFrame:
    """Strong headers plus the weak ones that fill holes of their series.

    Per document and lower-cased series: scores from STRONG are strong, from WEAK weak.  Without a
    strong one the best weak one is promoted.  Of each weak ordinal only the best counts; it is
    recovered if it lies between the ordinals of consecutive strong headers, or outside all.
    """
    h = headers.withColumn("series", F.lower(F.coalesce("section_key", F.lit("root")))).withColumn("place", F.coalesce("ordinal", F.lit(0)))
    group = Window.partitionBy("doc_id", "series")
    strong = F.col("score") >= STRONG
    weak = (F.col("score") >= WEAK) & ~strong
    best = F.row_number().over(group.orderBy(weak.desc(), F.desc("score"), "place", "chunk_index"))
    h = h.withColumn("promoted", weak & ~F.max(strong).over(group) & (best == 1)).withColumn("strong", strong | F.col("promoted"))
    s = h.where("strong").withColumn("recovered", F.col("recovered") | F.col("promoted"))
    s = s.withColumn("next", F.lead("ordinal").over(group.orderBy("place", "chunk_index")))
    w = h.where(weak & F.col("ordinal").isNotNull())
    w = w.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "series", "ordinal").orderBy(F.desc("score"), "chunk_index"))).where("rn = 1").drop("rn")
    between = s.where("next - ordinal > 1").select("doc_id", "series", F.col("ordinal").alias("lo"), F.col("next").alias("hi"))
    ends = s.groupBy("doc_id", "series").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last")).where("first is not null")
    below = ends.select("doc_id", "series", F.lit(None).cast("long").alias("lo"), F.col("first").alias("hi"))
    above = ends.select("doc_id", "series", F.col("last").alias("lo"), F.lit(None).cast("long").alias("hi"))
    holes = between.unionByName(below).unionByName(above).withColumnsRenamed({"doc_id": "d", "series": "s"})
    inside = (F.col("lo").isNull() | (F.col("ordinal") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("ordinal") < F.col("hi")))
    filled = w.join(holes, (F.col("doc_id") == F.col("d")) & (F.col("series") == F.col("s")) & inside, "left_semi").withColumn("recovered", F.lit(True))
    return s.drop("next").unionByName(filled).drop("series", "place", "promoted", "strong")


def number(headers: DataFrame) -> DataFrame:
    """``headers`` in order with header_id and section_id, counted from 1 per document."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "sentence_start", F.coalesce("ordinal", F.lit(0))))
    key = F.col("doc_id").cast("string")
    return headers.withColumn("n", n).withColumn("header_id", F.format_string("%s:h%d", key, "n")).withColumn("section_id", F.format_string("%s:s%d", key, "n"))
