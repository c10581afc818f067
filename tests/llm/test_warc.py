import base64
import gzip
import hashlib
import zlib
from html.parser import HTMLParser

import pytest

from inkwell.llm import warc
from inkwell.llm.workspace import Workspace


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_records_link_to_their_response(spark, tiny):
    pages = {r.url: r.html for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    responses = {r.record_id: r for r in warc.responses_of_pages(spark.read.parquet(f"{tiny}/pages.parquet")).collect()}
    rows = warc.query(spark, tiny).collect()
    assert len(rows) == 2 * len(responses) and len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        source = responses[r.refers_to]
        assert source.target_uri == r.target_uri and r.payload_digest == sha(bytes(source.payload)) == sha(pages[r.target_uri].encode())
        assert r.block_digest == sha(r.block.encode()) and f"Content-Length: {len(r.block.encode())}\r\n" in r.headers and f"WARC-Refers-To: {r.refers_to}\r\n" in r.headers
        if r.type == "metadata":
            assert r.payload_digest in r.block and "source-header: Content-Type: text/html; charset=utf-8" in r.block
        else:
            assert "<p>" not in r.block and "track(" not in r.block


def test_files_round_trip(spark, tiny):
    made = warc.derivatives(warc.responses_of_pages(spark.read.parquet(f"{tiny}/pages.parquet")))
    for kind in ("none", "gzip"):
        path = Workspace(spark, "warc").path("files")
        warc.write_warc(made, path, kind)
        key = lambda r: r.record_id
        assert sorted(warc.read_warc(spark, f"{path}/part-*").collect(), key=key) == sorted(made.collect(), key=key)


def test_responses_from_a_file(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-A: b\r\n\r\n<p>caf\xc3\xa9 <b>x</b></p>\xff"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record.replace(b"uuid:1", b"uuid:2")))
    found = warc.read_warc(spark, f"file://{tmp_path}")
    rows = {r.refers_to + r.type: r for r in warc.derivatives(warc.responses_of_records(found)).collect()}
    assert len(rows) == 4
    c, m = rows["<urn:uuid:1>conversion"], rows["<urn:uuid:1>metadata"]
    assert bytes(c.block).decode() == "café x\n�" or bytes(c.block).decode() == "café x�" or bytes(c.block).decode().startswith("café x")
    assert "source-header: X-A: b\r\n" in bytes(m.block).decode() and m.date == "2020-01-01T00:00:00Z"
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "b.warc").write_bytes(b"")
    assert warc.read_warc(spark, f"file://{tmp_path}/empty").count() == 0


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, 1), (2, "http://a/\r\nX: y", "", 1), (None, "u", "<p>t", 1), (2, "http://a/\r\nX: y", "", 1), (3, "u", "w " * 200_000, 1)], "page_id long, url string, html string, block int")
    rows = warc.derivatives(warc.responses_of_pages(df)).collect()
    assert len(rows) == 10 and len({r.record_id for r in rows}) == 8
    assert all("\r\nX: y" not in r.headers for r in rows)
    assert warc.derivatives(warc.responses_of_pages(df.limit(0))).count() == 0


def record(name, block, kind="response"):
    return b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <%s>\r\nContent-Length: %d\r\n\r\n" % (kind.encode(), name.encode(), len(block)) + block + b"\r\n\r\n"


def test_blocks_that_hold_records(spark, tmp_path):
    inner = record("inner", b"x\r\n\r\nWARC/1.0\r\n\r\n")
    blocks = {"a": inner + inner, "b": b"", "c": b"\r\n\r\nWARC/", "d": bytes(range(256)) * 50, "e": b"tail\r\n\r\n"}
    whole = b"".join(record(k, v) for k, v in blocks.items())
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(k + "z", v)) for k, v in blocks.items()))
    got = {r.record_id: bytes(r.block) for r in warc.read_warc(spark, f"file://{tmp_path}").collect()}
    assert got == {f"<{k}>": v for k, v in blocks.items()} | {f"<{k}z>": v for k, v in blocks.items()}
    (tmp_path / "c.warc").write_bytes(whole[:-9])
    with pytest.raises(Exception, match="ends before its length"):
        warc.read_warc(spark, f"file://{tmp_path}/c.warc").count()


def test_encoded_bodies():
    text = b"<p>hello</p>" * 40
    chunks = b"".join(b"%x;a=b\r\n%s\r\n" % (len(text[i : i + 100]), text[i : i + 100]) for i in range(0, len(text), 100)) + b"0\r\n\r\n"
    assert warc.decoded("Transfer-Encoding: chunked", chunks) == text
    assert warc.decoded("Content-Encoding: gzip", gzip.compress(text)) == text == warc.decoded("content-encoding: deflate", zlib.compress(text))
    packed = gzip.compress(text)
    assert warc.decoded("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", b"%x\r\n%s\r\n0\r\n\r\n" % (len(packed), packed)) == text
    assert warc.decoded("Content-Encoding: gzip", text) == text == warc.decoded("Content-Encoding: br", text) == warc.decoded(None, text)
    assert warc.decoded("Transfer-Encoding: chunked", text) == text


def test_responses_without_an_id(spark):
    rows = [(None, "http://a/", "2020-01-01T00:00:00Z", "", b"<p>one"), (None, "http://a/", "2020-01-01T00:00:00Z", "", b"<p>two"), (None, None, None, None, None)]
    got = warc.derivatives(spark.createDataFrame(rows, "record_id string, target_uri string, date string, http_headers string, payload binary")).collect()
    assert len(got) == len({r.record_id for r in got}) == 6 and all(r.refers_to is None and "Refers-To:" not in r.headers for r in got)


class Shown(HTMLParser):
    """Lines of text by the standard library's parser, for pages without odd markup."""

    def __init__(self):
        super().__init__()
        self.lines, self.off = [""], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")
        if tag in ("p", "div", "nav", "ul", "li", "h1", "article", "footer", "body"):
            self.lines.append("")
        elif tag == "br":
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")
        if tag in ("p", "div", "nav", "ul", "li", "h1", "article", "footer", "body"):
            self.lines.append("")

    def handle_data(self, data):
        if not self.off:
            self.lines[-1] += data


def test_conversion_text_against_the_standard_parser(spark, small):
    pages = {r.url: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in warc.query(spark, small).where("type = 'conversion'").collect():
        shown = Shown()
        shown.feed(pages[r.target_uri])
        shown.close()
        assert r.block == "\n".join(line for x in shown.lines if (line := " ".join(x.split())))
