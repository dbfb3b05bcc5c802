"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response yields one metadata record, JSON with the source's WARC fields, the HTTP
status and headers, title and links, and one conversion record with the page's plain
text. Both refer to the source by its identifier and carry its target, date and
digests. All of it is built-in expressions over one pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "record_id string, warc_type string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, block binary"


def digest(data: Column) -> Column:
    """sha1: and the SHA-1 in base 32, as the format's digests are written."""
    hexed = F.sha1(data.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*parts), _HEX32, _BASE32))


def urn(*parts: Column | str) -> Column:
    """An identifier that depends on the parts alone, so that a task run again gives the same."""
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def responses(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """Response records of pages: RECORD's columns. A null html is a response without a body; a null url stays null."""
    body = F.coalesce(F.col(html), F.lit(""))
    size = F.octet_length(body)
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(f"{CRLF}X-Page: "), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(CRLF + CRLF))
    block = F.concat(head, body)
    return pages.select(
        urn(F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit(""))).alias("record_id"),
        F.lit("response").alias("warc_type"),
        F.col(url).alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        digest(body).alias("payload_digest"),
        digest(block).alias("block_digest"),
        block.cast("binary").alias("block"),
    )


#: What browsers read as windows-1252, and the characters that it has where ISO-8859-1 has controls.
LATIN = ("iso-8859-1", "iso8859-1", "latin1", "latin-1", "l1", "us-ascii", "ascii", "windows-1252", "cp1252", "x-cp1252")
_CONTROLS = "".join(map(chr, [0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F]))
_CP1252 = _CONTROLS.encode("latin-1").decode("cp1252")


def decoded(body: Column, head: Column) -> Column:
    """The text of a body's bytes by the charset of its header: windows-1252 and what is read as it, else UTF-8, where bytes that aren't become U+FFFD."""
    charset = F.lower(F.regexp_extract(head, r"(?i)\ncontent-type:[^\r\n]*charset\s*=\s*[\"']?([^\s\"';]+)", 1))
    return F.when(charset.isin(*LATIN), F.translate(F.decode(body, "ISO-8859-1"), _CONTROLS, _CP1252)).otherwise(F.make_valid_utf8(body.cast("string")))


def plain_text(html: Column) -> Column:
    """Text of HTML: scripts, styles, titles and comments go, blocks end lines, the named entities of markup are read, white space is collapsed."""
    x = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>", " ")
    x = F.regexp_replace(x, r"\s+", " ")
    x = F.regexp_replace(x, r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|main|aside|blockquote|pre|dd|dt|dl|form|figure)\b[^>]*>", "\n")
    x = F.regexp_replace(x, "<[^>]*>", "")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = F.replace(x, F.lit(f"&{name};"), F.lit(char))
    x = F.regexp_replace(x, r" *\n[ \n]*", "\n")
    return F.regexp_replace(F.regexp_replace(x, r"^[ \n]+", ""), r"[ \n]+$", "")


def derivatives(records: DataFrame) -> DataFrame:
    """Two records for each response: (record_id, warc_type, refers_to, target_uri, warc_date, content_type, source_payload_digest, source_block_digest, status, block_digest, content_length, block).

    Records of other types are passed over, as are responses without a block or an identifier, which nothing could refer to. A block
    without an empty line is all header; without a status line the status is null. Digests that the source lacks stay null, those it
    has are copied as they are. Bodies are decoded as in decoded(); transfer and content encodings are not undone. Records that occur
    twice are derived twice, with equal identifiers. Texts of any length are converted whole. An empty table gives no rows; other
    columns aren't read.
    """
    raw = F.col("block").cast("binary")
    first = F.substring_index(raw.cast("string"), CRLF + CRLF, 1)
    parts = records.where("warc_type = 'response' and block is not null and record_id is not null")
    parts = parts.select("record_id", "target_uri", "warc_date", "content_type", "payload_digest", "block_digest", raw.alias("raw"), first.alias("first"))
    parts = parts.withColumns({"head": F.make_valid_utf8("first"), "bytes": F.expr("substring(raw, octet_length(first) + 5)")}).withColumn("body", decoded(F.col("bytes"), F.col("head")))
    lines = F.split("head", CRLF)
    fields = F.filter(F.slice(lines, 2, F.size(lines)), lambda x: F.instr(x, ":") > 1)
    headers = F.transform(fields, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    status = F.expr("try_cast(nullif(regexp_extract(head, '^HTTP/[0-9.]+ ([0-9]{3})', 1), '') as int)")
    title = F.regexp_replace(F.trim(F.regexp_extract("body", r"(?is)<title[^>]*>(.*?)</title", 1)), r"\s+", " ")
    quoted = F.regexp_extract_all("body", F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    links = F.transform(quoted, lambda x: F.btrim(x, F.lit("\"'")))
    meta = F.to_json(
        F.struct(
            F.struct(F.col("record_id").alias("WARC-Record-ID"), F.lit("response").alias("WARC-Type"), F.col("target_uri").alias("WARC-Target-URI"), F.col("warc_date").alias("WARC-Date"), F.col("content_type").alias("Content-Type"), F.col("payload_digest").alias("WARC-Payload-Digest"), F.col("block_digest").alias("WARC-Block-Digest")).alias("warc"),
            F.struct(status.alias("status"), headers.alias("headers"), F.octet_length("bytes").alias("body_length")).alias("http"),
            F.struct(title.alias("title"), links.alias("links")).alias("html"),
        )
    )
    both = F.array(F.struct(F.lit("metadata").alias("t"), F.lit("application/json").alias("k"), meta.alias("b")), F.struct(F.lit("conversion").alias("t"), F.lit("text/plain").alias("k"), plain_text(F.col("body")).alias("b")))
    out = parts.select("record_id", "target_uri", "warc_date", "payload_digest", "block_digest", status.alias("status"), F.explode(both).alias("x"))
    return out.select(
        urn(F.col("x.t"), F.col("record_id")).alias("record_id"),
        F.col("x.t").alias("warc_type"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        F.col("x.k").alias("content_type"),
        F.col("payload_digest").alias("source_payload_digest"),
        F.col("block_digest").alias("source_block_digest"),
        "status",
        digest(F.col("x.b")).alias("block_digest"),
        F.octet_length("x.b").alias("content_length"),
        F.col("x.b").alias("block"),
    )


def serialized(derived: DataFrame) -> Column:
    """A derivative as the bytes of a WARC record. Fields that are null are left out."""
    del derived
    field = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(CRLF))).otherwise(F.lit(""))
    head = F.concat(F.lit(f"WARC/1.0{CRLF}"), field("WARC-Type", "warc_type"), field("WARC-Record-ID", "record_id"), field("WARC-Refers-To", "refers_to"), field("WARC-Target-URI", "target_uri"), field("WARC-Date", "warc_date"), field("WARC-Block-Digest", "block_digest"), field("X-Source-Payload-Digest", "source_payload_digest"), field("X-Source-Block-Digest", "source_block_digest"), field("Content-Type", "content_type"), field("Content-Length", "content_length"), F.lit(CRLF))
    return F.concat(head.cast("binary"), F.col("block").cast("binary"), F.lit(CRLF + CRLF).cast("binary"))


def inflated(raw: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, plain or in gzip members, in pieces. A member that can't be read on gives what came before the damage; the next is looked for by its first bytes."""
    if raw[:2] != b"\x1f\x8b":
        yield from (raw[i : i + piece] for i in range(0, len(raw), piece))
        return
    at = 0
    while 0 <= at < len(raw):
        one, fed = zlib.decompressobj(31), at
        try:
            while fed < len(raw) and not one.eof:
                out = one.decompress(raw[fed : fed + piece])
                fed = min(fed + piece, len(raw)) - len(one.unused_data)
                yield out
        except zlib.error:
            fed = at + 1
        at = raw.find(b"\x1f\x8b\x08", fed)


class _Reader:
    """Lines and blocks of bytes that come in pieces; what follows mark can be read again."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at, self.mark = pieces, b"", 0, 0

    def more(self) -> bool:
        for piece in self.pieces:
            if piece:
                self.held = self.held[self.mark :] + piece
                self.at, self.mark = self.at - self.mark, 0
                return True
        return False

    def line(self) -> bytes:
        while (end := self.held.find(b"\n", self.at)) < 0 and self.more():
            pass
        end = len(self.held) if end < 0 else end + 1
        out, self.at = self.held[self.at : end], end
        return out

    def take(self, size: int) -> bytes:
        got, pieces = len(self.held) - self.at, [self.held]
        while got < size and (piece := next(self.pieces, None)) is not None:
            pieces.append(piece)
            got += len(piece)
        self.held = b"".join(pieces)
        out, self.at = self.held[self.at : self.at + size], min(self.at + size, len(self.held))
        return out

    def ends_record(self, block: bytes) -> bool:
        """Whether a block ends here: the two line ends of the format follow, or the file's end, or other line ends and the next record, which the block must not hold the begin of."""
        while len(self.held) - self.at < 64 and self.more():
            pass
        after = self.held[self.at : self.at + 64]
        rest = after.lstrip(b"\r\n")
        return after.startswith(b"\r\n\r\n") or not rest or rest.startswith(b"WARC/") and b"\nWARC/" not in block


def parse_records(raw: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or compressed record by record.

    A record without a readable length, or with one at which no record can end, is passed over, as are lines between records; reading
    goes on at the next line that begins with WARC/.
    """
    reader = _Reader(inflated(raw))
    while True:
        reader.mark = reader.at
        line = reader.line()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := reader.line()).strip() and not line.startswith(b"WARC/"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        reader.at -= len(line) if line.startswith(b"WARC/") else 0
        reader.mark = reader.at
        size = fields.get("content-length", "")
        if line.startswith(b"WARC/") or not (size.isascii() and size.isdigit()):
            continue
        block = reader.take(int(size))
        if len(block) < int(size) or not reader.ends_record(block):
            reader.at = reader.mark
            continue
        yield {"record_id": fields.get("warc-record-id"), "warc_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "warc_date": fields.get("warc-date"), "content_type": fields.get("content-type"), "payload_digest": fields.get("warc-payload-digest"), "block_digest": fields.get("warc-block-digest"), "block": block}


def read_records(files: DataFrame, content: str = "content", held: int = 4 << 20) -> DataFrame:
    """RECORD's columns from WARC files in a binary column (spark.read.format("binaryFile")); damage is passed over as in parse_records. Null and empty files give no rows. Records go on as they are read, held bytes at a time; a file's own bytes are in memory whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for raw in batch["c"]:
                rows, size = [], 0
                for row in parse_records(bytes(raw)) if raw else ():
                    rows.append(row)
                    size += len(row["block"]) + 500
                    if size > held:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.select(F.col(content).alias("c")).where("c is not null").mapInPandas(run, RECORD)
