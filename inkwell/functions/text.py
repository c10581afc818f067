"""Scalar text functions, all as column expressions that stay inside generated code.

Regular expressions run in Unicode mode, so that classes and case follow Unicode as the rules ask.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


# fixed values: the characters that count as white space at the ends of a text
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.btrim(_col(c), F.lit(SPACE))


def words(c: Column | str) -> Column:
    """White-space separated words."""
    return F.filter(F.split(_col(c), r"(?U)\s+", -1), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def tokens(c: Column | str) -> Column:
    """Lower-cased words, the unit of sparse retrieval."""
    return words(F.lower(_col(c)))


def count_matches(c: Column | str, pattern: str) -> Column:
    """Characters of a class in the text: what is left when all others go."""
    return F.char_length(F.regexp_replace(_col(c), pattern, ""))


def is_upper(c: Column | str) -> Column:
    """At least one cased character and no lower-case one."""
    c = _col(c)
    return (c == F.upper(c)) & (c != F.lower(c))


def lines(c: Column | str) -> Column:
    """Lines of a text; line ends include vertical tab, form feed and the Unicode separators."""
    return F.split(_col(c), "\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]", -1)


def sentences(c: Column | str) -> Column:
    """Parts after ``.``, ``!`` or ``?`` before white space, and between line breaks; trimmed, without empty ones."""
    parts = F.split(strip(c), r"(?U)(?<=[.!?])\s+|\n+", -1)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def is_heading_sentence(c: Column | str) -> Column:
    """Short and in capitals, or mostly capitals over at most twelve words."""
    c = _col(c)
    n = word_count(c)
    return ((n <= 6) & is_upper(c)) | ((count_matches(c, r"[^\p{Lu}]") / F.greatest(F.char_length(c), F.lit(1)) > 0.55) & (n <= 12))


def is_heading_block(text: Column | str, size: Column | str, weight: Column | str) -> Column:
    """Large type, or mostly capitals in bold."""
    text = _col(text)
    ratio = count_matches(text, r"[^\p{Lu}]") / F.greatest(F.char_length(text), F.lit(1))
    return (text != "") & ((_col(size) >= 16) | ((ratio > 0.55) & F.lower(_col(weight)).isin("bold", "700")))


def language(c: Column | str) -> Column:
    """struct(code, confidence, method): a script heuristic, not language identification."""
    c = _col(c)
    n = F.char_length(c)
    ascii_ = count_matches(c, r"[^\x00-\x7F]") / n
    latin = count_matches(c, "[^a-zA-Z]") / n
    vowels = count_matches(F.lower(c), "[^aeiou]") / n
    score = F.least(F.lit(1.0), ascii_ * 0.4 + latin * 0.4 + vowels * 0.2)
    unknown = (ascii_ < 0.5) & (latin < 0.3)
    blank = F.coalesce(strip(c) == "", F.lit(True))
    return F.when(blank, F.struct(F.lit("und").alias("code"), F.lit(0.0).alias("confidence"), F.lit("empty").alias("method"))).otherwise(
        F.struct(F.when(unknown, "und").otherwise("en").alias("code"), F.when(unknown, F.lit(0.35)).otherwise(F.round(score, 3)).alias("confidence"), F.lit("heuristic").alias("method"))
    )


def digest_embedding(c: Column | str, dim: int = 16) -> Column:
    """array<double>: byte i of the SHA-256 over 255, times cos(i + 1)."""
    return let(F.sha2(_col(c), 256), lambda h: F.array(*[F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("double") / 255.0 * F.cos(F.lit(i + 1.0)) for i in range(dim)]))


def digest_vector(text: str, dim: int = 16) -> Column:
    """The same embedding of a text known to the driver, as a literal."""
    h = hashlib.sha256(text.encode()).digest()
    return F.array(*[F.lit(h[i] / 255.0 * math.cos(i + 1.0)) for i in range(dim)])


def hash_embedding(c: Column | str, dim: int = 16) -> Column:
    """Feature-hashed word counts scaled to length one; zeros without a word.  Stable across processes."""
    found = F.transform(F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(?U)(\w+)"), F.lit(1)), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    zeros = F.array(*[F.lit(0.0)] * dim)
    counts = F.aggregate(found, zeros, lambda acc, x: F.transform(acc, lambda v, i: F.when(i == x, v + 1.0).otherwise(v)))

    def scaled(pair: Column) -> Column:
        return F.transform(pair["v"], lambda x: F.when(pair["n"] > 0, x / pair["n"]).otherwise(0.0))

    return let(let(counts, lambda v: F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("n"))), scaled)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; a zero norm counts as one."""

    def norm(v: Column) -> Column:
        return let(F.sqrt(dot(v, v)), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n))

    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: dot(p["a"], p["b"]) / (norm(p["a"]) * norm(p["b"])))


def flow_score(token_count: Column, text: Column, first: Column, last: Column) -> Column:
    """Length over twenty plus the inverse of the sentence span."""
    length = F.when(F.coalesce(token_count, F.lit(0)) != 0, token_count).otherwise(word_count(text)).cast("double")
    span = F.greatest(F.coalesce(last, F.lit(0)) - F.coalesce(first, F.lit(0)) + 1, F.lit(1))
    return F.round(length * 0.05 + F.lit(1.0) / span, 4)


def energy_score(text: Column) -> Column:
    """Share of digits, capitals and the signs %, degree and plus-minus."""
    n = F.char_length(text)
    special = count_matches(text, r"[^\p{Nd}\p{Lu}%°±]")
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(special / n, 4))


def graph_score(path: Column) -> Column:
    """Inverse depth of a header path plus a twentieth of its parts; one half without a path."""
    parts = F.size(F.split(path, "/", -1))
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit(0.5)).otherwise(F.round(F.lit(1.0) / parts + 0.05 * parts, 4))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column | str) -> Column:
    """Compatibility forms composed; Spark has no such function, so texts beyond ASCII, and they alone, go to Python."""
    c = _col(c)
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def label(c: Column | str) -> Column:
    """A document label without white space at its ends; null where nothing is left."""
    s = strip(c)
    return F.when(s != "", s)


def slug(c: Column | str) -> Column:
    """Lower-case id with runs of other characters as one hyphen; null where nothing is left."""
    s = F.lower(F.regexp_replace(F.regexp_replace(strip(c), "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(s != "", s)


def file_slug(c: Column | str, limit: int = 180) -> Column:
    """File name of safe characters in compatibility form, at most ``limit`` long with its extension kept."""
    s = F.regexp_replace(F.regexp_replace(strip(nfkc(c)), "​", ""), "[^A-Za-z0-9._-]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^[-._]+|[-._]+$", "")
    s = F.when(s == "", F.lit("document")).otherwise(s)
    extension = F.regexp_extract(s, r"[^.](\.[^.]*)$", 1)
    base = F.substring(s, F.lit(1), F.char_length(s) - F.char_length(extension))
    cut = F.concat(F.regexp_replace(F.substring(base, F.lit(1), F.lit(limit) - F.char_length(extension)), r"[-_.]+$", ""), extension)
    return F.when(F.char_length(s) > limit, cut).otherwise(s)


def mask(c: Column | str) -> Column:
    """Stars for up to eight characters, else the first and last four."""
    s = F.trim(F.coalesce(_col(c), F.lit("")))
    return F.when(F.char_length(s) <= 8, F.regexp_replace(s, "(?s).", "*")).otherwise(F.concat(F.substring(s, 1, 4), F.lit("..."), F.substring(s, -4, 4)))


def mask_header(c: Column | str) -> Column:
    """An authorisation header with the part after the scheme masked."""
    c = _col(c)
    at = F.instr(c, " ")
    return F.when(at > 0, F.trim(F.concat(F.substring(c, F.lit(1), at - 1), F.lit(" "), mask(F.substring(c, at + 1, F.char_length(c)))))).otherwise(mask(c))


def double_extension(c: Column | str, allowed: tuple[str, ...] = (".pdf",)) -> Column:
    """Whether an allowed extension follows another one or that of a program."""
    c = F.lower(_col(c))
    out = F.lit(False)
    for ext in allowed:
        before = [x for x in (*allowed, ".exe", ".bat", ".com") if x != ext]
        base = F.substring(c, F.lit(1), F.char_length(c) - len(ext))
        bad = F.lit(False)
        for x in before:
            bad = bad | base.endswith(x)
        out = out | (c.endswith(ext) & bad)
    return out


def mime(content: Column | str) -> Column:
    """``application/pdf`` by signature, null (rejected) otherwise."""
    return F.when(F.substring(_col(content), 1, 5) == F.lit(b"%PDF-"), F.lit("application/pdf"))


def preview(c: Column | str, n: int = 256) -> Column:
    return F.substring(_col(c), 1, n)


def completion(user: Column, context: Column, max_tokens: int = 1024) -> Column:
    """The offline answer: the request, then the first five context lines up to a word limit."""
    found = F.filter(F.transform(lines(context), strip), lambda s: s != "")
    summary = F.array_join(F.slice(words(F.array_join(F.slice(found, 1, 5), " ")), 1, max_tokens), " ")
    return F.when(F.size(found) == 0, F.lit("No relevant context provided.")).otherwise(F.concat(strip(user), F.lit("\n\nAnswer: "), summary))
