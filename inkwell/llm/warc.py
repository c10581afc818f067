"""WARC derivatives: response records become linked metadata and conversion records.

A response record is a row (record_id, target_uri, date, headers, http_headers, payload).  For each
one the builder makes

* a ``conversion`` record: the payload's plain text, ``Content-Type: text/plain;charset=utf-8``,
* a ``metadata`` record in ``application/warc-fields``: the source's HTTP headers, its payload
  digest, its length and language attribute,

both with ``WARC-Refers-To`` naming the response, ``WARC-Refers-To-Target-URI`` and
``WARC-Refers-To-Date``, block digests of their own, and ids that are a function of the response's
id, so a repeated task writes the same bytes.  Digests are base-32 SHA-1, as is customary in WARC.
Everything is one narrow pass; no row meets another.

``read_warc`` and ``write_warc`` move records between files and tables.  Files are read as a stream of
records, so that a file may be larger than a task's memory.

Edge cases: null payloads are empty; a null url gives records without target URI; a response without
an id gives records that refer to none, with ids of their own from its URI, date and payload digest; bodies
that are not UTF-8 are decoded with replacement; a line break inside a header value becomes a space;
repeated rows give repeated records; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .html import blocks, invisible, parse
from .workspace import small_batches, spread

VERSION = "WARC/1.1"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
DATE = "2024-01-01T00:00:00Z"  # of synthetic responses
RECORD = "type string, record_id string, target_uri string, refers_to string, date string, payload_digest string, block_digest string, headers string, block binary"

_HTML = re.compile(r"""<!--.*?(?:-->|\Z)|<html(?=[\s/>])((?:[^>"']|"[^"]*"|'[^']*'|["'])*+)""", re.I | re.S)
_LANG = re.compile(r"""(?:^|[\s"'/])lang\s*=\s*["']?\s*([A-Za-z0-9-]+)""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def header_block(fields: list[tuple[str, str | None]]) -> str:
    return "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v).strip()}\r\n" for k, v in fields if v is not None)


def record_bytes(headers: str, block: bytes) -> bytes:
    return f"{VERSION}\r\n{headers}\r\n".encode() + block + b"\r\n\r\n"


def plain_text(payload: str) -> str:
    """All visible text of a page, a line per block; templates and navigation stay, as in a conversion record."""
    return "\n".join(blocks(parse(payload), set(), dropped=invisible))


def language(source: str) -> str | None:
    """The lang attribute of the first html element that has one; comments hold no elements."""
    for tag in _HTML.finditer(source):
        if tag[1] and (said := _LANG.search(tag[1])):
            return said[1].lower()
    return None


def derive(record_id: str | None, target_uri: str | None, date: str | None, http_headers: str, payload: bytes) -> list[tuple]:
    """The conversion and the metadata record of one response, as tuples in the order of RECORD."""
    source = payload.decode("utf-8", "replace")
    text = plain_text(source).encode()
    payload_digest = digest(payload)
    fields = [("source-payload-digest", payload_digest), ("source-payload-length", str(len(payload))), ("language", language(source))]
    fields += [("source-header", line) for line in http_headers.split("\r\n") if line]
    out = []
    for kind, content_type, block in (("conversion", "text/plain;charset=utf-8", text), ("metadata", "application/warc-fields", header_block(fields).encode())):
        own, block_digest = named_id(f"{record_id if record_id is not None else f'{target_uri} {date} {payload_digest}'}/{kind}"), digest(block)
        headers = header_block(
            [
                ("WARC-Type", kind),
                ("WARC-Record-ID", own),
                ("WARC-Refers-To", record_id),
                ("WARC-Refers-To-Target-URI", target_uri),
                ("WARC-Refers-To-Date", date),
                ("WARC-Target-URI", target_uri),
                ("WARC-Date", date or DATE),
                ("WARC-Block-Digest", block_digest),
                ("WARC-Source-Payload-Digest", payload_digest),
                ("Content-Type", content_type),
                ("Content-Length", str(len(block))),
            ]
        )
        out.append((kind, own, target_uri, record_id, date or DATE, payload_digest, block_digest, headers, block))
    return out


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 8 else pa.string()) for i, c in enumerate(columns)], names=[c.split()[0] for c in RECORD.split(", ")])


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for row in zip(*(batch.column(c) for c in ("record_id", "target_uri", "date", "http_headers", "payload"))):
            record_id, uri, date, http, payload = (x.as_py() for x in row)
            rows += derive(record_id, uri, date, http or "", payload or b"")
            if len(rows) >= 256:
                yield _to_batch(rows)
                rows = []
        yield _to_batch(rows)


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records (RECORD) for each row of ``responses`` (record_id, target_uri, date, http_headers, payload binary)."""
    small_batches(responses.sparkSession)
    columns = ["record_id", "target_uri", "date", "http_headers", "payload"]
    return responses.select(columns).mapInArrow(_derive, RECORD)


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """Response records of a table (page_id, url, html); ids follow from page id, url and content."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    name = F.concat_ws("\n", F.col("page_id").cast("string"), F.col("url"), F.sha1(payload))
    h = F.sha1(name)
    hexes = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(payload).cast("string"), F.lit("\r\n"))
    return pages.select(F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *hexes), F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(DATE).alias("date"), http.alias("http_headers"), payload.alias("payload"))


def _parsed(raw: bytes) -> tuple[dict[str, str], str, bytes]:
    """(headers, header text, the rest) of a record's bytes after its version line's ``WARC/``."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, "".join(x + "\r\n" for x in lines), rest


def _read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of pieces between ``SEPARATOR``s; a block that holds one is put together again by its length."""
    rows, waiting = [], None
    for batch in batches:
        for piece, path in zip(batch.column("piece"), batch.column("path")):
            raw, path = piece.as_py(), path.as_py()
            if waiting is not None:
                if waiting[1] != path:
                    raise ValueError(f"a record of {waiting[1]} ends before its length; if a block with WARC records in it lies on a split, read the file gzipped")
                raw = waiting[0] + SEPARATOR + raw
            elif raw.startswith(b"WARC/"):
                raw = raw[5:]  # the first record of a file
            if not raw.strip():
                continue
            h, text, block = _parsed(raw)
            if not re.match(rb"[0-9]", raw) or "content-length" not in h:
                raise ValueError(f"no WARC record in {path}: {raw[:40]!r}")
            size = int(h["content-length"])
            if len(block) < size:
                waiting = raw, path
                continue
            waiting = None
            rows.append((h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-date"), h.get("warc-payload-digest") or h.get("warc-source-payload-digest"), h.get("warc-block-digest"), text, block[:size]))
            if len(rows) >= 64:
                yield _to_batch(rows)
                rows = []
    if waiting is not None:
        raise ValueError(f"a record of {waiting[1]} ends before its length")
    yield _to_batch(rows)


SEPARATOR = b"\r\n\r\nWARC/"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (RECORD) of WARC files, plain (which Spark may split) or gzipped (one task each).

    A record's length tells where its block ends, whatever the block holds; a file cut short is an error.
    """
    small_batches(spark)
    pieces = spark.read.option("lineSep", SEPARATOR.decode()).text(path)
    return pieces.select(F.col("value").cast("binary").alias("piece"), F.input_file_name().alias("path")).mapInArrow(_read_records, RECORD)


def decoded(http_headers: str | None, body: bytes) -> bytes:
    """The payload of an HTTP body: chunks joined, gzip and deflate undone; what cannot be undone stays as it is."""
    said = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(":") for x in (http_headers or "").split("\r\n"))}
    if "chunked" in said.get("transfer-encoding", ""):
        out, at = [], 0
        while m := _CHUNK.match(body, at):
            n = int(m[1], 16)
            out.append(body[m.end() : m.end() + n])
            at = m.end() + n + 2
            if n == 0:
                break
        body = b"".join(out) if out else body
    for coding in reversed(said.get("content-encoding", "").replace(" ", "").split(",")):
        try:
            if coding in ("gzip", "x-gzip"):
                body = gzip.decompress(body)
            elif coding == "deflate":
                body = zlib.decompress(body, -15 if body[:1] != b"\x78" else 15)
        except (OSError, EOFError, zlib.error):
            break
    return body


_CHUNK = re.compile(rb"([0-9A-Fa-f]{1,15})[^\r\n]*\r\n")


def _decode_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = [b if b is None else decoded(h, b) for h, b in zip(batch.column("http_headers").to_pylist(), batch.column("payload").to_pylist())]
        yield batch.set_column(batch.schema.get_field_index("payload"), "payload", pa.array(bodies, pa.binary()))


def responses_of_records(found: DataFrame) -> DataFrame:
    """The response records of ``read_warc`` split into HTTP headers and payload, transfer and content encodings undone."""
    at = F.expr("instr(decode(block, 'ISO-8859-1'), '\r\n\r\n')")
    rows = found.where("type = 'response'").withColumn("at", at)
    http = F.when(F.col("at") > 0, F.expr("decode(substring(block, 1, at + 1), 'ISO-8859-1')"))
    rows = rows.select("record_id", "target_uri", "date", http.alias("http_headers"), F.when(F.col("at") > 0, F.expr("substring(block, at + 4, length(block))")).otherwise(F.col("block")).alias("payload"))
    return rows.mapInArrow(_decode_bodies, rows.schema)


def write_warc(found: DataFrame, path: str, compression: str = "none") -> None:
    """Writes text records (conversion, metadata) as WARC files, one per partition, with Spark's committer.

    Each record is one element of a text file whose line feed is the record's last byte.
    """
    value = F.concat(F.lit(f"{VERSION}\r\n"), F.col("headers"), F.lit("\r\n"), F.decode("block", "UTF-8"), F.lit("\r\n\r"))
    found.select(value.alias("value")).write.option("compression", compression).option("lineSep", "\n").text(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derivatives(responses_of_pages(spread(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id")))
    return found.withColumn("block", F.decode("block", "UTF-8"))
