"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from four patterns (email, ip, card, phone), leftmost and non-overlapping per
kind; they always stay.  A skip-chain CRF then labels each document's *entity-like* pieces.  Its
variables are

* the base spans, clamped to their kinds,
* runs of digit groups, at whatever distance and however separated, that repeat the digits of a base
  phone or card, or a phone's last seven or more (leading zeros aside), or the four numbers of an address,
* pieces with ``@`` or a bracketed ``at`` whose local part is that of a base email,
* all other white-space tokens with a digit or ``@``.

Everything else is outside by definition and carries no variable.

* Node potentials: a log-linear model over the number of digits, ``@``, letters and the neighbouring
  words.  What the patterns themselves test (plus signs, separators, dots) is left out, as every base
  span would have it; instead ``PRIOR`` log odds speak against a label where no pattern matches.
* Chain potentials join variables of adjacent words.
* Skip potentials join consecutive occurrences, at any distance, of pieces that are repeated or
  similar in the ways above (or tokens with the same core), and each such piece with the first base
  span it repeats, so that k repeats cost fewer than 2 k edges, none is left out and none is far from
  a base span.

Parameters are fitted piecewise on a bounded sample of ``SAMPLE`` different texts, those with the
smallest hashes: the node model by regularised likelihood over (features, label) counts, the edge
potentials from label co-occurrence with ``AGREE`` pseudo-counts of agreement.  Base spans are labels;
a variable that skip edges tie to one is unlabelled and counts for nothing; others are outside.
Loopy message passing runs a fixed number of damped rounds for all documents of a batch at once.
Pieces whose marginal for one label is at least ``ACCEPT`` and that a clamped variable supports over
skip edges become added spans, if they overlap no base span.

Spans are (kind, start, end) in code points, end exclusive.  Edge cases: null text is empty;
documents without entity-like tokens have no span; repeated rows and null ids are answered row by
row; an empty table gives an empty result; other columns are ignored; texts are read whole, with
patterns that need time linear in the text.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .sampling import smallest_keys
from .workspace import small_batches, spread

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0 is outside
SAMPLE = 5000
ROUNDS, DAMPING, ACCEPT = 12, 0.5, 0.9
PRIOR = 3.0
AGREE, STRONGEST = 3000, 8.0
LEAST = 7  # digits of a phone's end that still name it
MOST = 19  # digits of the longest entity
BATCH_VARIABLES = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_CORE = re.compile(r"^[^0-9A-Za-z+@]+|[^0-9A-Za-z]+$")
_ENTITY = re.compile(r"[0-9@]")
_RUN = re.compile(r"[0-9]++(?:[\s().\-/_+\[\]\u00b7\u2010-\u2015]{1,3}[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_AT = re.compile(r"@|[ ]?[\[({][ ]?(?:at|AT|@)[ ]?[\])}][ ]?")
_LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|[ ]?[\[({][ ]?(?:dot|DOT)[ ]?[\])}][ ]?)[A-Za-z0-9-]+)*")


def emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` is visited once, and each run before it walked once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


OWN, CONTEXT = 8, 21
UNMATCHED = 1  # the feature of variables under no base span
FEATURES = 2 + OWN + 2 * CONTEXT  # bias, unmatched, the piece itself, words before and after


def shape(piece: str) -> tuple[int, ...]:
    """Active features of a piece of text."""
    n = len(_digits(piece))
    on = [0 if n == 0 else 1 if n < 4 else 2 if n < 7 else 3 if n < 12 else 4 if n <= MOST else 5]
    return tuple(on + [6] * ("@" in piece or bool(_AT.search(piece))) + [7] * (n == 0 or any(c.isalpha() for c in piece)))


def context(word: str) -> tuple[int, ...]:
    """Active features of a neighbouring word."""
    if not word:
        return (0,)
    core = _CORE.sub("", word).lower()
    if not core or _ENTITY.search(core):
        return (1 if core else 2, *((3,) if word[-1] in ":=" else ()))
    return (5 + zlib.crc32(core.encode("utf-8", "replace")) % (CONTEXT - 5), *((3,) if word[-1] in ":=" else ()), *((4,) if word[0].isupper() else ()))


def entity_keys(text: str, a: int, kind: int, b: int) -> list[str]:
    """What a base span has in common with its repeats."""
    if kind == 0:
        return ["@" + text[a : text.index("@", a)].lower()]
    if kind == 1:
        return ["." + ".".join(p.lstrip("0") or "0" for p in text[a:b].split("."))]
    d = _digits(text[a:b]).lstrip("0")
    return ["#" + d] if kind == 2 else ["#" + d[i:] for i in range(max(1, len(d) - LEAST + 1)) if d[i] != "0"]


def token_keys(token: str) -> list[str]:
    core = _CORE.sub("", token)
    out = ["=" + core.lower()] if len(core) >= 6 else []
    if len(d := _digits(core).lstrip("0")) >= LEAST:
        out.append("#" + d)
    return out


def repeats(text: str, known: set[str]) -> list[tuple[int, int, str]]:
    """(start, end, key) of pieces that repeat one of the ``known`` keys, longest first from the left, without overlaps."""
    found = []
    if any(k[0] != "@" for k in known):
        for run in _RUN.finditer(text):
            groups = [m.span() for m in _GROUP.finditer(text, run.start(), run.end())]
            for i, (a, _) in enumerate(groups):
                if a and text[a - 1].isalnum():
                    continue
                digits = ""
                for j in range(i, len(groups)):
                    digits += text[slice(*groups[j])]
                    if len(digits) > MOST + 2:
                        break
                    b = groups[j][1]
                    if b < len(text) and text[b].isalnum():
                        continue
                    keys = ["#" + digits.lstrip("0")]
                    if j - i == 3:
                        keys.append("." + ".".join(text[slice(*g)].lstrip("0") or "0" for g in groups[i : j + 1]))
                    for key in keys:
                        if key in known:
                            found.append((a - (a > 0 and text[a - 1] in "+("), b, key))
    if any(k[0] == "@" for k in known):
        last = 0
        for m in _AT.finditer(text):
            a = m.start()
            while a > last and text[a - 1] in _LOCAL:
                a -= 1
            last = m.end()
            if (key := "@" + text[a : m.start()].lower()) in known and a < m.start():
                domain = _LOOSE_DOMAIN.match(text, m.end())
                found.append((a, domain.end() if domain else m.start() + len(m[0].rstrip()), key))
    out, end = [], 0
    for a, b, key in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= end:
            out.append((a, b, key))
            end = b
    return out


@dataclass
class Graph:
    """Variables of one document: bounds, features, base label (0 if none), edges, and whether skip edges tie it to a base span."""

    spans: list[tuple[int, int]]
    features: list[tuple[int, ...]]
    labels: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    tied: list[bool] = field(default_factory=list)


def graph(text: str, base: list[tuple[int, int, int]]) -> Graph | None:
    if not _ENTITY.search(text):
        return None
    pieces: list[tuple[int, int, int, list[str]]] = []  # start, end, label, keys
    end = 0
    for a, k, b in sorted(base, key=lambda x: (x[0], -x[2])):
        if a >= end:
            pieces.append((a, b, k + 1, entity_keys(text, a, k, b)))
            end = b
    taken = sorted((a, b) for a, _, b in base)
    if pieces:
        pieces += [(a, b, 0, [key]) for a, b, key in _outside(repeats(text, {key for p in pieces for key in p[3]}), taken)]
        pieces.sort()
    spans, features, labels, chain, skip, last = [], [], [], [], [], {}
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    whole: list[tuple[int, int, int, list[str], int, int]] = []  # with the first and last token touched
    at = 0
    for i, (a, b) in enumerate(tokens):
        under = False
        while at < len(pieces) and pieces[at][0] < b:
            p = pieces[at]
            if p[1] <= b or i + 1 == len(tokens) or tokens[i + 1][0] >= p[1]:
                whole.append((*p, bisect.bisect_right(tokens, (p[0], len(text))) - 1, i))
                at += 1
                under = True
            else:
                break
        under = under or at < len(pieces) and pieces[at][0] < b or bool(whole) and whole[-1][1] > a
        if not under and _ENTITY.search(text, a, b):
            whole.append((a, b, 0, token_keys(text[a:b]), i, i))
    clamped: dict[str, int] = {}  # the first base span with a key
    for v, piece in enumerate(whole):
        if piece[2]:
            for key in piece[3]:
                clamped.setdefault(key, v)
    before = -2
    for v, (a, b, label, keys, first, final) in enumerate(whole):
        left = text[tokens[first][0] : a] or (text[slice(*tokens[first - 1])] if first > 0 else "")
        right = text[b : tokens[final][1]] or (text[slice(*tokens[final + 1])] if final + 1 < len(tokens) else "")
        spans.append((a, b))
        labels.append(label)
        on = (0, *(() if label else (UNMATCHED,)), *(2 + f for f in shape(text[a:b])), *(2 + OWN + f for f in context(left)), *(2 + OWN + CONTEXT + f for f in context(right)))
        features.append(on)
        if v and first - before in (0, 1):
            chain.append((v - 1, v))
        for key in keys:
            if key in last:
                skip.append((last[key], v))
            last[key] = v
            if not label and key in clamped:
                skip.append((min(v, clamped[key]), max(v, clamped[key])))
        before = final
    if not spans:
        return None
    skip = sorted(set(skip))
    tied = [bool(x) for x in labels]
    while any(tied[x] != tied[y] for x, y in skip):  # a sweep each way follows a chain of occurrences to its ends
        for edges in (skip, skip[::-1]):
            for x, y in edges:
                tied[x] = tied[y] = tied[x] or tied[y]
    return Graph(spans, features, labels, chain, skip, tied)


def _outside(found: list[tuple[int, int, str]], taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """The pieces that overlap none of the sorted spans ``taken``."""
    out, at, reach = [], 0, 0  # reach: the furthest end of the spans that start before the piece ends
    for a, b, key in found:
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= a:
            out.append((a, b, key))
    return out


@dataclass
class Model:
    weights: np.ndarray  # FEATURES x LABELS
    chain: np.ndarray  # log potentials, LABELS x LABELS
    skip: np.ndarray


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(nodes: Counter, chain: Counter, skip: Counter, l2: float = 1.0, steps: int = 300) -> Model:
    """Piecewise estimates from counts of (features, label), and of label pairs on edges."""
    w = np.zeros((FEATURES, LABELS))
    if nodes:
        rows = sorted(nodes)
        x = np.zeros((len(rows), FEATURES))
        y = np.array([r[1] for r in rows])
        n = np.array([nodes[r] for r in rows], float)
        for i, (on, _) in enumerate(rows):
            x[i, [f for f in on if f != UNMATCHED]] = 1  # a constant of the model, not learned
        velocity = np.zeros_like(w)
        for _ in range(steps):
            p = _softmax(x @ w)
            p[np.arange(len(y)), y] -= 1
            velocity = 0.9 * velocity - 0.05 * (x.T @ (p * n[:, None]) + l2 * w) / n.sum() * 10
            w += velocity

    w[UNMATCHED] = [0.0] + [-PRIOR] * (LABELS - 1)

    def counts(pairs: Counter, agree: float) -> np.ndarray:
        c = np.ones((LABELS, LABELS)) + agree * np.eye(LABELS)
        for (a, b), n in pairs.items():
            c[a, b] += n
            c[b, a] += n
        return c

    c = counts(chain, 4)
    p = c / c.sum()
    near = np.clip(np.log(p / np.outer(p.sum(axis=1), p.sum(axis=0))), -3.0, 3.0)
    c = counts(skip, AGREE)
    same = np.sqrt(np.diag(c))
    return Model(w, near, np.clip(np.log(c / np.outer(same, same)), -STRONGEST, 0.0))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for text in batch.column("text"):
            text = text.as_py() or ""
            g = graph(text, base_spans(text))
            if g:
                known = [bool(y) or not t for y, t in zip(g.labels, g.tied)]
                found.update(("n", tuple(f), y) for f, y, k in zip(g.features, g.labels, known) if k)
                found.update(("c", (g.labels[a],), g.labels[b]) for a, b in g.chain if known[a] and known[b])
                found.update(("s", (g.labels[a],), g.labels[b]) for a, b in g.skip if known[a] and known[b])
        rows = list(found.items())
        yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], pa.string()), pa.array([list(r[0][1]) for r in rows], pa.list_(pa.int32())), pa.array([r[0][2] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], names=["what", "on", "label", "n"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the model on ``sample`` different texts of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    usable = docs.where("text is not null").select("text", F.lit("").alias("one"), F.xxhash64("text").alias("key"))
    keys = smallest_keys(spark, usable, "one", sample)
    if keys is None:
        return fit(Counter(), Counter(), Counter())
    chosen = usable.join(F.broadcast(keys.select("key")), "key").groupBy("key").agg(F.min("text").alias("text"))
    found = chosen.select("text").mapInArrow(_statistics, "what string, on array<int>, label int, n long")
    nodes, chain, skip = Counter(), Counter(), Counter()
    for r in found.groupBy("what", "on", "label").agg(F.sum("n").alias("n")).collect():  # at most one row per token of the sample
        if r.what == "n":
            nodes[tuple(r.on), r.label] += r.n
        else:
            (chain if r.what == "c" else skip)[r.on[0], r.label] += r.n
    return fit(nodes, chain, skip)


def marginals(model: Model, graphs: list[Graph]) -> list[np.ndarray]:
    """Beliefs of each graph's variables after loopy message passing, all graphs at once."""
    sizes = [len(g.spans) for g in graphs]
    first = np.r_[0, np.cumsum(sizes)]
    node = np.zeros((first[-1], LABELS))
    flat = [f for g in graphs for f in g.features]
    width = np.array([len(f) for f in flat])
    at = np.repeat(np.arange(len(flat)), width)
    np.add.at(node, at, model.weights[np.concatenate([np.array(f) for f in flat])])
    label = np.concatenate([np.array(g.labels) for g in graphs])
    clamped = np.flatnonzero(label)
    node[clamped] = -1e9  # no number of messages outweighs a clamp
    node[clamped, label[clamped]] = 0.0
    node -= node.max(axis=1, keepdims=True)
    edges = [(a + o, b + o, kind) for g, o in zip(graphs, first) for kind, e in ((0, g.chain), (1, g.skip)) for a, b in e]
    if edges:
        a, b, kind = (np.array(x) for x in zip(*edges))
        source, target = np.r_[a, b], np.r_[b, a]
        potential = np.exp(np.stack([model.chain, model.skip])[np.r_[kind, kind]])
        reverse = np.r_[np.arange(len(a), 2 * len(a)), np.arange(len(a))]
        message = np.full((len(source), LABELS), 1.0 / LABELS)
        for _ in range(ROUNDS):
            log = np.log(message)
            total = node.copy()
            np.add.at(total, target, log)
            cavity = total[source] - log[reverse]
            out = np.einsum("el,elm->em", np.exp(cavity - cavity.max(axis=1, keepdims=True)), potential)
            message = DAMPING * message + (1 - DAMPING) * np.maximum(out / out.sum(axis=1, keepdims=True), 1e-12)
        np.add.at(node, target, np.log(message))
    p = _softmax(node)
    return [p[i:j] for i, j in zip(first[:-1], first[1:])]


def added_spans(text: str, base: list[tuple[int, int, int]], g: Graph, p: np.ndarray) -> list[tuple[int, int, int]]:
    """Accepted pieces that a clamped variable supports over skip edges."""
    label, before = list(g.labels), None
    while label != before:
        before = list(label)
        for edges in (g.skip, g.skip[::-1]):
            for a, b in edges:
                for x, y in ((a, b), (b, a)):
                    if label[x] and not label[y] and p[y, label[x]] >= ACCEPT:
                        label[y] = label[x]
    out = []
    for (a, b), was, now in zip(g.spans, g.labels, label):
        if now and not was:
            if not any(x < b and a < y for x, _, y in base):
                out.append((a, now - 1, b))
    return out


def find_spans(model: Model, texts: list[str]) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, added spans) of each text."""
    waiting: list[tuple[str, list, Graph | None]] = []
    size = 0
    for i, text in enumerate(texts):
        base = base_spans(text)
        g = graph(text, base) if base else None  # without a clamped variable no span can be supported
        waiting.append((text, base, g))
        size += len(g.spans) if g else 0
        if size >= BATCH_VARIABLES or i + 1 == len(texts):
            graphs = [g for _, _, g in waiting if g]
            beliefs = iter(marginals(model, graphs) if graphs else [])
            for t, b, g in waiting:
                yield b, added_spans(t, b, g, next(beliefs)) if g else []
            waiting, size = [], 0


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _finder(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [[] for _ in KINDS], [], []
            for base, added in find_spans(model, [t.as_py() or "" for t in batch.column("text")]):
                for k in range(len(KINDS)):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(sorted(base + added)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return run


def personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of ``docs``; trains on ``docs`` if no model is given."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small_batches(docs.sparkSession)
    model = model or train(docs)
    return docs.mapInArrow(_finder(model), "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id"))
