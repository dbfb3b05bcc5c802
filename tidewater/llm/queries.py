"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe, htmltext, linededup, minhash, mixing, ogg, quality, suffixdedup, tokencount, warc
from tidewater.llm.common import BASE_A, BASE_B, read
from tidewater.llm.registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.train(docs, read(spark, sf_dir, "labels")), keep_scores=True)


_M = "18446744073709551616::UHUGEINT"


def _times(a: str, b: str) -> str:
    """The product modulo 2**64."""
    return f"((({a})::UHUGEINT * ({b})::UHUGEINT) % {_M})::UBIGINT"


def _mixed(x: str, name: str) -> str:
    """A query of name(..., h) with h spread as common.mix does, from one with x."""
    one = _times("xor(x, x >> 30)", f"{0xBF58476D1CE4E5B9}::UBIGINT")
    two = _times("xor(y, y >> 27)", f"{0x94D049BB133111EB}::UBIGINT")
    return f"{name} AS (SELECT * EXCLUDE (x, y, z), xor(z, z >> 31) AS h FROM (SELECT *, {two} AS z FROM (SELECT *, {one} AS y FROM ({x}))))"


@query(
    "op3_minhash_near_dedup",
    f"""
WITH RECURSIVE w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS k, len(ws) AS n FROM (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '[a-z0-9[:^ascii:]]+') AS ws FROM documents WHERE text IS NOT NULL)),
bytes AS (SELECT w, strlen(w) AS n, unnest(range(strlen(w))) AS i, hex(w) AS x FROM (SELECT DISTINCT w FROM w)),
longest AS MATERIALIZED (SELECT max(n) AS most FROM bytes),
powers AS (SELECT 0 AS i, 1::UBIGINT AS p UNION ALL SELECT i + 1, {_times("p", f"{BASE_A}::UBIGINT")} FROM powers, longest WHERE i < most),
{_mixed(f"SELECT w, xor((sum((('0x' || x[2 * b.i + 1:2 * b.i + 2])::INTEGER + 1)::HUGEINT * p) % {_M.replace('UHUGEINT', 'HUGEINT')})::UBIGINT, n::UBIGINT << 48) AS x FROM bytes b JOIN powers ON powers.i = b.i GROUP BY w, n", "words")},
placed AS (SELECT doc_id, k, n, h, coalesce(lead(h) OVER o, 2) AS h1, coalesce(lead(h, 2) OVER o, 3) AS h2 FROM w JOIN words USING (w) WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
{_mixed(f"SELECT DISTINCT doc_id, (({_times('h', f'{BASE_A}::UBIGINT')}::UHUGEINT + {_times('h1', f'{pow(BASE_A, 2, 1 << 64)}::UBIGINT')} + {_times('h2', f'{pow(BASE_A, 3, 1 << 64)}::UBIGINT')}) % {_M})::UBIGINT AS x FROM placed WHERE k <= n - 3 OR k = 0", "grams")},
{_mixed(f"SELECT i, {_times('i', f'{BASE_B}::UBIGINT')} AS x FROM range(1, 65) AS r(i)", "seeds")},
sig AS (SELECT doc_id, i, min({_times("xor(g.h, s.h)", f"{BASE_A}::UBIGINT")}) >> 32 AS v FROM grams g, seeds s GROUP BY doc_id, i),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sig a JOIN sig b ON a.i = b.i AND a.v = b.v AND a.doc_id <> b.doc_id GROUP BY ALL HAVING count(*) >= 28),
reached AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON p.a = r.b)
SELECT a AS doc_id, (SELECT min(b) FROM reached r WHERE r.a = pairs.a) AS class_id, count(*) AS links FROM pairs GROUP BY a
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


@query(
    "op8_line_dedup",
    r"""
WITH RECURSIVE l AS (
  SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i
  FROM (SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
  WHERE NOT regexp_full_match(x, '[ \t\r\x0b\f]*')),
ids AS (SELECT doc_id, i, dense_rank() OVER (ORDER BY x) AS id FROM l),
runs AS (
  SELECT 1 AS k, doc_id, i, c FROM (SELECT doc_id, i, id AS c, count(*) OVER (PARTITION BY id) AS m FROM ids) WHERE m > 1
  UNION ALL
  SELECT k, doc_id, i, c FROM (
    SELECT r.k + 1 AS k, r.doc_id, r.i, dense_rank() OVER (ORDER BY r.c, t.id) AS c, count(*) OVER (PARTITION BY r.c, t.id) AS m
    FROM runs r JOIN ids t ON t.doc_id = r.doc_id AND t.i = r.i + r.k) WHERE m > 1),
longest AS (SELECT doc_id, max(k) AS k FROM runs WHERE k >= 2 GROUP BY doc_id),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY c ORDER BY doc_id, i) AS place FROM runs WHERE k = 2) WHERE place > 1),
gone AS (SELECT DISTINCT l.doc_id, l.n FROM later JOIN l ON l.doc_id = later.doc_id AND l.i IN (later.i, later.i + 1)),
lost AS (SELECT doc_id, count(*) AS m FROM gone GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS m FROM l GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(x, chr(10) ORDER BY n) AS text
  FROM (SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
  ANTI JOIN gone USING (doc_id, n) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN lost.m > 0 THEN kept.text ELSE d.text END AS text, d.lang, d.source,
  CASE WHEN lost.m > 0 THEN length(kept.text) ELSE d.n_chars END AS n_chars,
  CAST(coalesce(lost.m, 0) AS INTEGER) AS lines_deleted, CAST(coalesce(longest.k, 0) AS INTEGER) AS longest_run
FROM documents d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN held USING (doc_id) LEFT JOIN longest USING (doc_id)
WHERE lost.m IS NULL OR lost.m < held.m
""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(read(spark, sf_dir, "documents"), with_runs=True, long_words=None)


@query("op9_mix_sources")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"), placed=True)


@query("op7_bpe_encode")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read(spark, sf_dir, "documents"))


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(read(spark, sf_dir, "pages"))


def _base32(digits: str) -> str:
    return f"'sha1:' || translate(list_aggregate(list_transform(range(8), lambda i: lpad(to_base(('0x' || {digits}[5 * i + 1:5 * i + 5])::INTEGER, 32), 4, '0')), 'string_agg', ''), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"


def _urn(h: str) -> str:
    return f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32] || '>'"


@query(
    "op5_warc_derivatives",
    rf"""
WITH bodies AS (
  SELECT url, html AS body, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)
    || chr(13) || chr(10) || 'X-Page: ' || page_id || chr(13) || chr(10) || chr(13) || chr(10) AS head, page_id, md5('response' || chr(10) || page_id || chr(10) || url) AS h FROM pages),
source AS (SELECT page_id, url, body, {_urn("h")} AS refers_to, sha1(body) AS p, sha1(head || body) AS b, strlen(body) AS n FROM bodies),
digested AS (SELECT *, {_base32("p")} AS pd, {_base32("b")} AS bd FROM source),
texts AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>', ' ', 'g'), '\s+', ' ', 'g'),
    '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|main|aside|blockquote|pre|dd|dt|dl|form|figure)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS x FROM digested),
plain AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
    ' *\n[ \n]*', chr(10), 'g'), '^[ \n]+', ''), '[ \n]+$', '') AS plain FROM texts),
both_ AS (
  SELECT 'conversion' AS warc_type, 'text/plain' AS content_type, plain AS block, * FROM plain
  UNION ALL
  SELECT 'metadata', 'application/json', to_json({{
    'warc': {{'WARC-Record-ID': refers_to, 'WARC-Type': 'response', 'WARC-Target-URI': url, 'WARC-Date': '2024-01-01T00:00:00Z', 'Content-Type': 'application/http; msgtype=response', 'WARC-Payload-Digest': pd, 'WARC-Block-Digest': bd}},
    'http': {{'status': 200, 'headers': [{{'name': 'Content-Type', 'value': 'text/html; charset=utf-8'}}, {{'name': 'Content-Length', 'value': n::VARCHAR}}, {{'name': 'X-Page', 'value': page_id::VARCHAR}}], 'body_length': n}},
    'html': {{'title': regexp_replace(trim(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title', 1)), '\s+', ' ', 'g'), 'links': list_transform(regexp_extract_all(body, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), lambda x: trim(x, '"'''))}}}})::VARCHAR, * FROM plain),
named AS (SELECT *, md5(warc_type || chr(10) || refers_to) AS d, sha1(block) AS s FROM both_)
SELECT {_urn("d")} AS record_id, warc_type, refers_to, url AS target_uri, '2024-01-01T00:00:00Z' AS warc_date, content_type,
  pd AS source_payload_digest, bd AS source_block_digest, 200::INTEGER AS status, {_base32("s")} AS block_digest, strlen(block)::INTEGER AS content_length, block
FROM named
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(read(spark, sf_dir, "pages")))


@query(
    "op6_ogg_packets",
    """
WITH t AS (
  SELECT conv_id, turn, text, strlen(text) AS n, role, dense_rank() OVER (PARTITION BY conv_id ORDER BY role) AS serial
  FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL AND turn IS NOT NULL),
p AS (
  SELECT conv_id, serial, row_number() OVER w AS packet, sum((n // 255 + 255) // 255) OVER w AS page, 312 + sum(960 * greatest(1, (n + 63) // 64)) OVER w AS granule, n, text
  FROM t WINDOW w AS (PARTITION BY conv_id, serial ORDER BY turn, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id AS id, serial::BIGINT AS serial, packet::INTEGER AS packet, page::BIGINT AS page, granule::BIGINT AS granule, true AS exact, 'opus' AS codec,
  round((granule - 312) / 48000.0, 6)::DOUBLE AS seconds, true AS complete, n::INTEGER AS size, text FROM p
UNION ALL
SELECT DISTINCT conv_id, serial, 0, 0, 0, true, 'opus', 0.0, true, (19 + strlen(role))::INTEGER, NULL FROM t
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ogg.packets(ogg.containers(read(spark, sf_dir, "conversations")))
    text = F.when(F.col("packet") > 0, F.col("data").cast("string"))
    return found.select("id", "serial", "packet", "page", "granule", "exact", "codec", F.round("seconds", 6).alias("seconds"), "complete", F.octet_length("data").alias("size"), text.alias("text"))


@query(
    "op10_suffix_dedup",
    """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9[:^ascii:]]+') AS ws FROM documents WHERE text IS NOT NULL),
passages AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 50], ' ') AS p FROM (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)),
repeated AS (SELECT doc_id, i, k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY p) AS n, row_number() OVER (PARTITION BY p ORDER BY doc_id, i) AS k FROM passages) WHERE n > 1),
spans AS (SELECT doc_id, i, k, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM repeated)),
later AS (SELECT doc_id, i, span, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS cut FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM spans WHERE k > 1)),
cuts AS (SELECT doc_id, span, sum(b - a) AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS cuts FROM (SELECT doc_id, span, cut, min(i) AS a, max(i) + 50 AS b FROM later GROUP BY ALL) GROUP BY ALL)
SELECT s.doc_id, min(i)::INTEGER AS start_word, (max(i) + 50)::INTEGER AS end_word, coalesce(any_value(cuts.n), 0)::INTEGER AS later_words, coalesce(any_value(cuts.cuts), '') AS cuts
FROM spans s LEFT JOIN cuts ON cuts.doc_id = s.doc_id AND cuts.span = s.span GROUP BY s.doc_id, s.span
""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.repeated_passages(read(spark, sf_dir, "documents"))
    later = F.aggregate("cuts", F.lit(0), lambda n, c: n + c["end"] - c["start"])
    cuts = F.concat_ws(",", F.transform("cuts", lambda c: F.concat_ws("-", c["start"], c["end"])))
    return found.select("doc_id", "start_word", "end_word", later.alias("later_words"), cuts.alias("cuts"))
