"""Main text of web pages after removal of site templates.

1. Each page is parsed once; every block element's subtree gets a hash of its tag, class, id, text
   and children.  The distinct subtrees of a page are counted per host over all different pages:
   rows and mirrors with the same main text count as one page, however many URLs they have.
2. A subtree is a template of its host if it occurs on at least ``MIN_PAGES`` pages and on at least
   ``SHARE`` of the host's pages, or ``MIN_INSIDE`` and ``SHARE_INSIDE`` within an article, where a
   passage that several articles quote must stay.  On large hosts a number of pages is enough,
   ``MANY`` or ``MANY_INSIDE``, whatever their share: for subtrees of at least ``LONG`` words, which
   do not recur by chance, and for shorter ones if they are on ``SHARE_SHORT`` of the pages.  An
   article or main element and what holds one is never a template.
3. The second pass parses again, deletes template subtrees and what markup itself declares as
   furniture (navigation, headers, footers, sidebars, notices, adverts, forms, comments, scripts,
   styles), and joins the blocks of all articles.  A class or id declares furniture if all its words
   are names of furniture or of layout, at least one of furniture: ``ad-slot`` does, ``social-history``
   does not.

Templates are few beside the pages: up to ``BROADCAST_TEMPLATES`` they go to the second pass by broadcast,
so that no page is shuffled.  More of them come back to pages by joins on (host, hash) and on the digest of
host and html, with the same result.  Counts are combined map-side; a hot host or a hot page is no group
anywhere.

Character references are decoded, white space inside a block becomes one space, blocks are joined
by two line feeds in page order.

Edge cases: null or empty html gives an empty text; a null url is a host of its own; pages without
an article or main element fall back to the body without menus, that is lists of links alone
and blocks of three or more links with nothing but signs between them; unclosed and misnested tags
are repaired as browsers do in the common cases; repeated rows, rows of one page_id under several
URLs and null ids are answered row by row; where nothing but templates is left on a page its text is
empty; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .workspace import Workspace, spread

MIN_PAGES, SHARE, MIN_INSIDE, SHARE_INSIDE = 3, 0.5, 5, 0.9
MANY, MANY_INSIDE, LONG, SHARE_SHORT = 100, 1000, 4, 0.05
BROADCAST_TEMPLATES = 500_000  # of eight bytes each

_TOKEN = re.compile(r"""<(?:!--(.*?)(?:-->|\Z)|([!?][^>]*)>?|(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z))""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAMES = re.compile(r"[a-z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
DROPPED = frozenset(
    "script style textarea title xmp noframes noscript template head nav aside footer form button select option input iframe object embed applet svg math canvas audio video map dialog menu".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: words of a class or id that declare furniture
FURNITURE = frozenset(
    """nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidenav footer masthead banner ad ads adv advert adverts
    advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay
    newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments reply replies
    respond disqus widget widgets pagination pager toolbar skip skiplink copyright""".split()
)
#: words that say where or how something is shown
LAYOUT = frozenset(
    """box bar block wrap wrapper container content section area slot list item items link links button buttons icons post posts top bottom left
    right site page global primary secondary main inner outer header head title body text unit panel col column row group form thread wp js
    media field fixed sticky mobile desktop small large first last story stories article articles""".split()
)
#: elements of which a browser shows no text; head is left out, as one that is not closed holds the body
INVISIBLE = frozenset("script style title noframes noscript template iframe object embed applet audio video canvas datalist".split())
_CLOSES_P = BLOCKS - {"body", "html"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
_SCOPES = frozenset("table ul ol dl select body html article section div main aside nav header footer form td th".split())


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []


def parse(source: str) -> Node:
    """A lenient tree; children are nodes and decoded strings."""
    root = node = Node("#root", {}, None)
    at, low, n = 0, None, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            node.children.append(unescape(source[at:]))
            break
        if m.start() > at:
            node.children.append(unescape(source[at : m.start()]))
        at = m.end()
        name = m[4]
        if name is None:
            continue
        name = name.lower()
        if m[3]:
            up = node
            while up.parent is not None and up.tag != name:
                up = up.parent
            if up.parent is not None:
                node = up.parent
            elif name == "p":
                node.children.append(Node("p", {}, node))
            continue
        raw = m[5]
        if name in _CLOSES_P:
            up = node
            while up.parent is not None and up.tag not in _SCOPES and up.tag != "p":
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if name in _SIBLINGS:
            ends, up = _SIBLINGS[name], node
            while up.tag in ends or (up.parent is not None and up.tag not in _SCOPES):
                if up.tag in ends:
                    node = up.parent
                up = up.parent
        attrs = {}
        if raw and not raw.isspace():
            for key, value in _ATTRIBUTE.findall(raw):
                attrs.setdefault(key.lower(), unescape(value[1:-1] if value[:1] in "\"'" and value else value))
        child = Node(name, attrs, node)
        node.children.append(child)
        if name in VOID or raw.endswith("/") and name in ("svg", "path", "use"):
            continue
        if name in RAW:
            low = low if low is not None else source.lower()
            if len(low) != n:  # a letter whose lower case is longer
                low = re.sub(r"[A-Z]+", lambda x: x[0].lower(), source)
            end = low.find(f"</{name}", at)
            text = source[at : end if end >= 0 else n]
            child.children.append(unescape(text) if name in ("title", "textarea") else text)
            at = n if end < 0 else (source.find(">", end) + 1 or n)
            continue
        node = child
    return root


def names(node: Node) -> list[list[str]]:
    """The words of each class and of the id."""
    said = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
    return [_NAMES.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()) for x in said.split()]


def declared(said: list[list[str]], kinds: frozenset[str]) -> bool:
    """Whether a class or id consists of words of ``kinds``, layout and numbers, one at least of ``kinds``."""
    return any(any(w in kinds for w in x) and all(w in kinds or w in LAYOUT or w.isdigit() for w in x) for x in said)


_COMMENTS = frozenset("comment comments reply replies respond disqus".split())


def invisible(node: Node, inside: bool) -> bool:
    """Whether the element is not shown; ``inside`` does not matter."""
    attrs = node.attrs
    if node.tag in INVISIBLE or "hidden" in attrs or node.tag == "input" and attrs.get("type", "").lower() == "hidden":
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I))


def furniture(node: Node, inside: bool) -> bool:
    """Whether markup declares the element not to be content; ``inside`` an article, headers may be its title."""
    tag, attrs = node.tag, node.attrs
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if not attrs:
        return False
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    if tag in ("html", "body", "main"):
        return False
    said = names(node)
    if tag == "article":
        return attrs.get("itemprop") == "comment" or declared(said, _COMMENTS)
    return declared(said, FURNITURE) or not inside and any(x == ["header"] or "header" in x and declared([x], frozenset(["header"])) for x in said)


def subtrees(root: Node) -> dict[int, tuple[int, bool, bool]]:
    """id(node) -> (hash, inside an article, of LONG words or more) of each block element with content below html and body."""
    out: dict[int, tuple[int, bool, bool]] = {}
    order: list[tuple[Node, bool]] = []
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        order.append((node, inside))
        within = inside or node.tag in ("article", "main")
        stack += [(c, within) for c in node.children if isinstance(c, Node)]
    digests: dict[int, bytes] = {}
    words: dict[int, int] = {}
    holders: set[int] = set()  # articles and what holds one
    for node, inside in reversed(order):
        h = hashlib.blake2b(f"{node.tag}\0{node.attrs.get('class', '')}\0{node.attrs.get('id', '')}".encode("utf-8", "replace"), digest_size=8)
        full, n = False, 0
        if node.tag in ("article", "main") and node.parent is not None or id(node) in holders:
            holders |= {id(node), id(node.parent)}
        for c in node.children:
            if isinstance(c, str):
                if said := c.split():
                    h.update(b"\1" + " ".join(said).encode("utf-8", "replace"))
                    full = True
                    n += max(len(said), sum(map(len, said)) // 16)  # also where words have no spaces
            else:
                h.update(b"\2" + digests[id(c)])
                full = True
                n += words[id(c)]
        digests[id(node)], words[id(node)] = h.digest(), n
        if full and node.tag in BLOCKS and node.tag not in ("html", "body") and id(node) not in holders:
            out[id(node)] = (int.from_bytes(h.digest(), "little", signed=True), inside, n >= LONG)
    return out


def _links_only(node: Node) -> int:
    """The number of links of a subtree in which all letters and digits belong to links; else 0."""
    found, stack = 0, [(node, False)]
    while stack:
        x, link = stack.pop()
        if isinstance(x, str):
            if not link and any(c.isalnum() for c in x):
                return 0
        else:
            found += x.tag == "a"
            stack += [(c, link or x.tag == "a") for c in x.children]
    return found


def blocks(root: Node, deleted: set[int], inside: bool = False, dropped: Callable[[Node, bool], bool] = furniture, menus: bool = True) -> list[str]:
    """The text of each block below ``root``, without the elements that are ``dropped``; without ``menus``, lists and rows of links go too."""
    out: list[str] = []
    buffer: list[str] = []
    plain, links = False, 0  # of the block: has a letter or digit outside links; its links

    def flush() -> None:
        nonlocal plain, links
        if (text := " ".join("".join(buffer).split())) and (menus or plain or links < 3):
            out.append(text)
        buffer.clear()
        plain, links = False, 0

    stack: list[tuple[object, bool, bool]] = [(root, inside, False)]
    while stack:
        x, within, link = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            buffer.append(x)
            plain = plain or not (menus or link) and any(c.isalnum() for c in x)
        elif id(x) in deleted or x is not root and dropped(x, within) or not menus and x.tag in ("ul", "ol", "dl") and _links_only(x):
            buffer.append(" ")
        else:
            if x.tag in ("br", "img", "wbr") or x.tag in VOID:
                buffer.append("" if x.tag == "wbr" else " ")
                if x.tag == "hr":
                    flush()
                continue
            links += x.tag == "a"
            if x.tag in BLOCKS:
                flush()
                stack.append((None, within, link))
            within = within or x.tag in ("article", "main")
            stack += [(c, within, link or x.tag == "a") for c in reversed(x.children)]
    flush()
    return out


def main_text(root: Node, deleted: set[int]) -> str:
    """The blocks of all articles, or of the main elements, or of the body, joined by an empty line."""
    articles, mains, body = [], [], root
    stack = [(root, False, False)]
    while stack:
        node, article, main = stack.pop()
        if id(node) in deleted or node is not root and node.tag != "head" and furniture(node, article):
            continue
        if node.tag == "body":
            body = node
        if (node.tag == "main" or node.attrs.get("role", "").lower() == "main") and not main:
            mains.append(node)
            main = True
        if node.tag == "article" and not article:
            articles.append(node)
            article = True
        stack += [(c, article, main) for c in reversed(node.children) if isinstance(c, Node)]
    for places in (articles, mains):
        if texts := [t for p in places for t in blocks(p, deleted, True)]:
            return "\n\n".join(texts)
    return "\n\n".join(blocks(body, deleted, menus=False))


_TREES = "page binary, host string, same long, subtrees array<struct<hash:long,inside:boolean,long:boolean>>"


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct subtrees of each page, and a hash of its main text before templates go."""
    for batch in batches:
        same, found, ends = [], [], [0]
        for html in batch.column("html"):
            root = parse(html.as_py())
            found += sorted(set(subtrees(root).values()))
            ends.append(len(found))
            text = hashlib.blake2b(main_text(root, set()).encode("utf-8", "replace"), digest_size=8).digest()
            same.append(int.from_bytes(text, "little", signed=True))
        columns = [pa.array(x, kind) for x, kind in zip(list(zip(*found)) or [()] * 3, (pa.int64(), pa.bool_(), pa.bool_()))]
        trees = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["hash", "inside", "long"]))
        yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("host"), pa.array(same, pa.int64()), trees], names=["page", "host", "same", "subtrees"])


def _page_texts(templates: dict[str, frozenset[int]] | None):
    """Texts of pages without the templates of their host, or without the ``removed`` ones of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if templates is None:
                removed = [set(x or ()) for x in batch.column("removed").to_pylist()]
            else:
                removed = [templates.get(h) for h in batch.column("host").to_pylist()]
            texts = []
            for html, gone in zip(batch.column("html"), removed):
                root = parse(html.as_py() or "")
                deleted = {at for at, tree in subtrees(root).items() if tree[0] ^ tree[1] in gone} if gone else set()
                texts.append(main_text(root, deleted))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def host(url):
    """The host of a URL column, lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _key(hash_: Column, inside: Column) -> Column:
    """A subtree within an article and the same one elsewhere are two."""
    return hash_.bitwiseXOR(inside.cast("long"))


def extract(spark: SparkSession, pages: DataFrame, templates: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html); without ``templates`` only declared furniture goes."""
    ws = Workspace(spark, "html")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    result = "page_id long, url string, text string, n_chars long"
    hosted = pages.withColumn("host", host(F.col("url"))).withColumn("page", F.unhex(F.sha2(F.concat_ws("\n", "host", "html"), 256)))
    if not templates:
        return hosted.select("page_id", "url", "html", "host").mapInArrow(_page_texts({}), result)
    found = ws.save(hosted.where("html <> ''").select("page", "host", "html").mapInArrow(_hashes, _TREES), "subtrees")
    different = ws.save(found.groupBy("host", "same").agg(F.min_by("subtrees", "page").alias("subtrees")), "different")
    sizes = different.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    counted = different.select("host", F.explode("subtrees").alias("t")).groupBy("host", "t.hash", "t.inside", "t.long").agg(F.count("*").alias("n"))
    counted = counted.where(F.col("n") >= F.when(F.col("inside"), F.lit(MIN_INSIDE)).otherwise(F.lit(MIN_PAGES)))
    share = F.when(F.col("inside"), F.lit(SHARE_INSIDE)).otherwise(F.lit(SHARE))
    many = (F.col("n") >= F.when(F.col("inside"), F.lit(MANY_INSIDE)).otherwise(F.lit(MANY))) & (F.col("long") | (F.col("n") >= SHARE_SHORT * F.col("pages")))
    chosen = ws.save(counted.join(sizes, "host").where((F.col("n") >= share * F.col("pages")) | many).select("host", _key(F.col("hash"), F.col("inside")).alias("hash")).distinct(), "templates")
    if chosen.count() <= BROADCAST_TEMPLATES:
        of: dict[str, set[int]] = {}
        for r in chosen.collect():
            of.setdefault(r.host, set()).add(r.hash)
        return hosted.select("page_id", "url", "html", "host").mapInArrow(_page_texts({h: frozenset(x) for h, x in of.items()}), result)
    once = found.groupBy("page").agg(F.any_value("host").alias("host"), F.any_value("subtrees").alias("subtrees"))  # equal pages hold equal subtrees
    each = once.select("page", "host", F.explode("subtrees").alias("t")).select("page", "host", _key(F.col("t.hash"), F.col("t.inside")).alias("hash")).distinct()
    removed = ws.save(each.join(chosen, ["host", "hash"]).groupBy("page").agg(F.collect_set("hash").alias("removed")), "removed")
    return hosted.join(removed, "page", "left").select("page_id", "url", "html", "removed").mapInArrow(_page_texts(None), result)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, spread(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id"))
