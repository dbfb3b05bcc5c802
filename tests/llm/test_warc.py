import base64
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidewater.llm import warc as W

SCHEMA = "page_id bigint, url string, html string, status string, block string"


def b32(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_derivatives(spark):
    html = '<head><title> A\n title </title></head><body><p>One &amp; two</p><!-- x --><script>"<p>"</script><div>Three <a class="q" href="/a">four</a><br>five &amp;lt; é</div></body>'
    pages = spark.createDataFrame([(1, "http://x/1", html, "s", "b"), (2, None, None, "s", "b"), (None, "u", "", "s", "b"), (1, "http://x/1", html, "s", "b")], SCHEMA)
    sources = W.responses(pages)
    by = {r.target_uri: r for r in sources.collect()}
    src = by["http://x/1"]
    block = bytes(src.block).decode()
    assert block.startswith("HTTP/1.1 200 OK\r\n") and block.endswith("\r\n\r\n" + html)
    assert src.payload_digest == b32(html) and src.block_digest == b32(block)
    rows = W.derivatives(sources).collect()
    assert len(rows) == 8 and len({r.record_id for r in rows}) == 6
    own = [r for r in rows if r.target_uri == "http://x/1"]
    for r in own:
        assert (r.refers_to, r.source_payload_digest, r.source_block_digest, r.status) == (src.record_id, src.payload_digest, src.block_digest, 200)
        assert r.block_digest == b32(r.block) and r.content_length == len(r.block.encode())
    text = next(r.block for r in own if r.warc_type == "conversion")
    assert text == "One & two\nThree four\nfive &lt; é"
    meta = json.loads(next(r.block for r in own if r.warc_type == "metadata"))
    assert meta["warc"]["WARC-Record-ID"] == src.record_id and meta["http"]["headers"][0] == {"name": "Content-Type", "value": "text/html; charset=utf-8"}
    assert meta["html"] == {"title": "A title", "links": ["/a"]}
    empty = [r for r in rows if r.target_uri is None]
    assert sorted(r.warc_type for r in empty) == ["conversion", "metadata"] and {r.block for r in empty if r.warc_type == "conversion"} == {""}


def test_odd_records(spark):
    rows = [("a", "request", "x", None, None, None, None, b"GET /"), ("b", "response", None, None, None, None, None, None), (None, "response", None, None, None, None, None, b"x"), ("c", "response", None, None, None, None, None, b"no status"), ("d", "response", None, None, None, "sha256:q", None, b"HTTP/1.0 404 Not Found\r\nbad line\r\nK:  v:w \r\n\r\n" + b"long text " * 200_000)]
    got = {(r.refers_to, r.warc_type): r for r in W.derivatives(spark.createDataFrame(rows, W.RECORD)).collect()}
    assert {k[0] for k in got} == {"c", "d"} and got["c", "conversion"].status is None
    d = got["d", "conversion"]
    assert d.status == 404 and d.source_payload_digest == "sha256:q" and d.source_block_digest is None and len(d.block) == 1_999_999
    assert json.loads(got["d", "metadata"].block)["http"]["headers"] == [{"name": "K", "value": "v:w"}]
    assert W.derivatives(spark.createDataFrame([], W.RECORD)).count() == 0


def test_write_and_read_again(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>page {i} ü</p>", "", "") for i in range(5)], SCHEMA)
    derived = W.derivatives(W.responses(pages))
    raw = [bytes(r.w) for r in derived.orderBy("record_id").select(W.serialized(derived).alias("w")).collect()]
    whole, zipped = b"".join(raw), b"".join(gzip.compress(x) for x in raw)
    files = spark.createDataFrame([(whole,), (zipped,), (whole[:-400],), (None,), (b"",), (b"junk",)], "content binary")
    back = W.read_records(files).collect()
    want = {(r.record_id, r.warc_type, r.target_uri, r.block_digest, r.block) for r in derived.collect()}
    assert {(r.record_id, r.warc_type, r.target_uri, r.block_digest, bytes(r.block).decode()) for r in back} == want and 20 < len(back) < 30


def record(block, length=None, name="response", n=0):
    size = b"" if length == "" else b"Content-Length: %s\r\n" % str(len(block) if length is None else length).encode()
    return b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <%d>\r\n%s\r\n%s\r\n\r\n" % (name.encode(), n, size, block)


@pytest.mark.parametrize("bad", [record(b"some block", 4), record(b"some block", 60), record(b"some block", 10**9), record(b"some block", ""), record(b"some block", "x7"), b"junk\r\n\r\n", b"WARC/1.0\r\nWARC-Type: cut off\r\n"])
def test_damage_costs_one_record(bad):
    good = [record(b"first\r\n\r\nWARC/ isn't a record", n=1), record(b"", n=2), record("ü\n".encode() * 9000, n=3), record(b"\xff\x00\r\n\r\n", n=4)]
    want = [[b"first\r\n\r\nWARC/ isn't a record", b"", "ü\n".encode() * 9000, b"\xff\x00\r\n\r\n"][i] for i in range(4)]
    for at in range(5):
        files = good[:at] + [bad] + good[at:]
        for raw in (b"".join(files), b"".join(gzip.compress(x) for x in files), gzip.compress(b"".join(files))):
            assert [r["block"] for r in W.parse_records(raw)] == want
    torn = bytearray(gzip.compress(good[0]))
    torn[len(torn) // 2] ^= 0xFF
    assert [r["block"] for r in W.parse_records(gzip.compress(good[1]) + bytes(torn) + gzip.compress(good[2]))][::1] in ([want[1], want[2]], [want[1], want[0], want[2]])


def test_bytes_and_charsets(spark):
    head = "HTTP/1.1 200 OK\r\ncontent-type: text/html; charset={}\r\n\r\n"
    cases = [("ISO-8859-1", "<p>caf\xe9 \x80 \x93x\x94".encode("latin-1"), "café € “x”"), ("utf-8", "<p>café €".encode(), "café €"), ('"UTF-8"', b"<p>a\xffb", "a\ufffdb"), ("unknown", "<p>é".encode(), "é")]
    raw = b"".join(record(head.format(c).encode() + body, n=i) for i, (c, body, _) in enumerate(cases))
    files = spark.createDataFrame([(raw,)], "content binary")
    records = W.read_records(files)
    assert [bytes(r.block) for r in records.collect()] == [head.format(c).encode() + body for c, body, _ in cases]
    rows = W.derivatives(records.withColumn("block_digest", W.digest(F.col("block")))).collect()
    got = {r.refers_to: r for r in rows if r.warc_type == "conversion"}
    for i, (c, body, text) in enumerate(cases):
        whole = head.format(c).encode() + body
        assert got[f"<{i}>"].block == text
        assert got[f"<{i}>"].source_block_digest == "sha1:" + base64.b32encode(hashlib.sha1(whole).digest()).decode()
        meta = json.loads(next(r.block for r in rows if r.refers_to == f"<{i}>" and r.warc_type == "metadata"))
        assert meta["http"]["body_length"] == len(body)


def test_links_in_any_quotes(spark):
    html = """<a href='/one'>1</a><A class=x HREF=/two>2</a><a data-href="no" href = "/three">3</a><a href="">4</a><abbr href="/no">5</abbr><a id=q>6</a>"""
    rows = W.derivatives(W.responses(spark.createDataFrame([(1, "u", html, "", "")], SCHEMA))).where("warc_type = 'metadata'").collect()
    assert json.loads(rows[0].block)["html"]["links"] == ["/one", "/two", "/three", ""]
