"""One query for each operator of the engine, over whole tables, with the SQL that checks it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import analysis, features, metrics, scoring
from tidewater.operators import postings as P
from tidewater.operators import search as S
from tidewater.operators.pool import pool, write_pool
from tidewater.operators.rankers import Bm25Ranker, LinearRanker, ModelRanker
from tidewater.plans import query as Q
from tidewater.plans.schema import Schema
from tidewater.serving import report
from tidewater.serving.router import Request
from tidewater.serving.service import SearchService
from tidewater.sources import documents as D
from tidewater.sources import shared, store
from tidewater.sources.files import Files
from tidewater.streaming.writer import IndexWriter, index_frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return D.spread(rows) if table == "documents" else rows


MAPPING = {"mappings": {"text": {"type": "text", "boost": 1.5, "position_decay": 0.5}, "lang": {"type": "keyword", "boost": 2.0}, "source": {"type": "keyword", "stored": True}}, "store_doc_quality": True}
WEIGHTS = [0.0] * features.COUNT
WEIGHTS[0], WEIGHTS[12], WEIGHTS[15] = 1.0, 3.0, 5.0


def corpus(spark: SparkSession, sf_dir: str, quality: bool = False) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("_id", F.col("doc_id").cast("string"))
    if not quality:
        return docs
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("float").alias("_quality"))
    return docs.join(labels, "doc_id", "left")


def documents_index(spark: SparkSession, sf_dir: str, quality: bool = False, segments: int = 1) -> P.Index:
    seg = F.pmod("doc_id", F.lit(segments)) if segments > 1 else 0
    return P.build(corpus(spark, sf_dir, quality), Schema.from_mappings(MAPPING), seg, F.col("doc_id"))


def parts_index(spark: SparkSession, sf_dir: str) -> P.Index:
    schema = Schema.from_mappings({"mappings": {"p_name": {"type": "text", "stored": True}, "p_brand": {"type": "keyword", "stored": True}, "p_type": {"type": "text"}}})
    return P.build(read(spark, sf_dir, "part").withColumn("_id", F.col("p_partkey").cast("string")), schema, 0, F.col("p_partkey"))


_STOP = ", ".join(f"'{w}'" for w in analysis.STOP_WORDS)


def _toks(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({c}, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP}))"


def _field_sql(doc: str, table: str, name: str, expr: str, text: bool) -> str:
    if text:
        return f"SELECT doc, '{name}' AS field, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT {doc} AS doc, {_toks(expr)} AS t FROM {table})"
    return f"SELECT {doc} AS doc, '{name}' AS field, {expr} AS term, 0 AS pos FROM {table} WHERE {expr} <> ''"


TOK = " UNION ALL ".join(_field_sql("doc_id", "documents", *x) for x in (("text", "text", True), ("lang", "lang", False), ("source", "source", False), ("_id", "doc_id::VARCHAR", False)))
POST = f"tok AS ({TOK}), p AS (SELECT doc, field, term, count(*) AS tf, least(min(pos), 65535) AS first_pos FROM tok GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents)"
PART_TOK = " UNION ALL ".join(_field_sql("p_partkey", "part", *x) for x in (("p_name", "p_name", True), ("p_type", "p_type", True), ("p_brand", "p_brand", False), ("_id", "p_partkey::VARCHAR", False)))
PART_POST = POST.replace(TOK, PART_TOK).replace("FROM documents)", "FROM part)")


def matched_sql(leaves: list[tuple[str, str]], where: str, post: str = POST) -> str:
    """CTEs up to m(doc, tf0.., fp0.., i0..): documents that match, with the leaves' tf, first place and idf. where speaks of t0, t1, ..."""
    pick = lambda c, i: f"max(CASE WHEN field = '{leaves[i][0]}' AND term = '{leaves[i][1]}' THEN {c} END)"
    n = range(len(leaves))
    cols = ", ".join(f"{pick('tf', i)} AS tf{i}, {pick('first_pos', i)} AS fp{i}" for i in n)
    dfs = ", ".join(f"count(*) FILTER (WHERE field = '{f}' AND term = '{t}') AS d{i}" for i, (f, t) in enumerate(leaves))
    some = " OR ".join(f"(field = '{f}' AND term = '{t}')" for f, t in leaves)
    idfs = ", ".join(f"ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1) AS i{i}" for i in n)
    flags = ", ".join(f"tf{i} IS NOT NULL AS t{i}" for i in n)
    return f"{post}, v AS (SELECT doc, {cols} FROM p WHERE {some} GROUP BY doc), d AS (SELECT {dfs} FROM p), s AS (SELECT n, {idfs} FROM d, n), m AS (SELECT * FROM (SELECT *, {flags} FROM v, s) WHERE {where})"


def score_sql(leaves: list[tuple[str, str]], times: list[int] | None = None) -> str:
    order = times or list(range(len(leaves)))
    return "0.0::DOUBLE + " + " + ".join(f"coalesce(i{i} * tf{i} * (1.2 + 1) / (tf{i} + 1.2), 0.0)" for i in order)


def search_sql(leaves, where: str, order: list[int] | None = None, post: str = POST) -> str:
    return f"WITH {matched_sql(leaves, where, post)} SELECT doc AS doc_id, round({score_sql(leaves, order)}, 6) AS score FROM m"


def found(index: P.Index, text: str, field: str = "text") -> DataFrame:
    return S.candidates(index, Q.parse(text, field)).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query("a1_tokens", f"SELECT doc_id, array_to_string({_toks('text')}, ' ') AS tokens, len({_toks('text')})::INTEGER AS n FROM documents")
def a1(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", analysis.standard_tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n"))


@query("a2_keyword_tokens", "SELECT source AS term, count(*) AS df FROM documents WHERE source <> '' GROUP BY 1")
def a2(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.explode(analysis.keyword_tokens(F.col("source"))).alias("term"))
    return docs.groupBy("term").agg(F.count("*").alias("df"))


@query("a3_stop_words", f"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+'))::INTEGER AS n_all, len({_toks('text')})::INTEGER AS n_kept FROM documents")
def a3(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all(text, F.lit(analysis.TOKEN), F.lit(0))).alias("n_all"), F.size(analysis.standard_tokens(text)).alias("n_kept"))


@query(
    "a4_token_offsets",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS t, regexp_split_to_array(text, '[A-Za-z0-9]+') AS g FROM documents),
u AS (SELECT doc_id, unnest(t) AS token, unnest(g[1:len(t)]) AS gap, unnest(range(len(t))) AS position FROM w),
o AS (SELECT doc_id, position, lower(token) AS token, strlen(token) AS n, sum(strlen(token) + strlen(gap)) OVER (PARTITION BY doc_id ORDER BY position) AS e FROM u)
SELECT doc_id, count(*) AS n, sum(position)::BIGINT AS positions, sum(e - n)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM o WHERE token NOT IN ({_STOP}) GROUP BY doc_id""",
)
def a4(spark, sf_dir):
    table = analysis.token_table(read(spark, sf_dir, "documents"), ["doc_id"], "text")
    return table.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("position").alias("positions"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


@query("g1_postings", f"WITH {POST} SELECT doc AS doc_id, field, term, tf::INTEGER AS tf, first_pos::INTEGER AS first_pos FROM p")
def g1(spark, sf_dir):
    return documents_index(spark, sf_dir).postings.select(F.col("doc").alias("doc_id"), "field", "term", "tf", "first_pos")


@query(
    "g3_token_weights",
    f"""WITH t AS (SELECT doc_id AS doc, unnest(k) AS term, unnest(range(len(k))) AS pos FROM (SELECT doc_id, {_toks('text')} AS k FROM documents)),
w AS (SELECT doc, term, max(CASE WHEN pos % 5 = 4 AND pos < 100 THEN 9.5 WHEN pos < 100 THEN (pos % 5) * 1.25 ELSE 1.0 END) AS w FROM t GROUP BY ALL)
SELECT term, count(*) AS df, max(CASE WHEN w <= 0 THEN 0 WHEN w >= 8 THEN 255 ELSE floor(w * 255 / 8 + 0.5) END)::SMALLINT AS most, sum(CASE WHEN w <= 0 THEN 0 WHEN w >= 8 THEN 255 ELSE floor(w * 255 / 8 + 0.5) END)::BIGINT AS total FROM w GROUP BY term""",
)
def g3(spark, sf_dir):
    schema = Schema.from_mappings({"mappings": {"text": {"type": "text", "store_token_weights": True}}})
    place = F.sequence(F.lit(0), F.lit(99))
    docs = corpus(spark, sf_dir).withColumn("text_weights", F.transform(place, lambda i: F.when(i % 5 == 4, F.lit(9.5)).otherwise((i % 5) * 1.25).cast("float")))
    own = P.build(docs, schema, 0, F.col("doc_id")).postings.where("field = 'text'")
    return own.groupBy("term").agg(F.count("*").alias("df"), F.max("weight_q8").alias("most"), F.sum("weight_q8").alias("total"))


@query("g4_term_stats", f"WITH {POST} SELECT field, term, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM p GROUP BY ALL")
def g4(spark, sf_dir):
    return documents_index(spark, sf_dir).term_stats().drop("seg")


@query("g5_global_df", f"WITH {POST} SELECT field, term, count(*) AS df FROM p GROUP BY ALL")
def g5(spark, sf_dir):
    stats = documents_index(spark, sf_dir, segments=3).term_stats()
    return stats.groupBy("field", "term").agg(F.sum("df").alias("df"))


@query("g6_field_stats", f"WITH {POST} SELECT field, count(DISTINCT doc) AS doc_count, sum(tf)::BIGINT AS sum_field_length, count(DISTINCT term) AS term_count FROM p GROUP BY field")
def g6(spark, sf_dir):
    return documents_index(spark, sf_dir).field_stats().drop("seg")


@query("g7_average_length", f"WITH {POST} SELECT field, round(sum(tf) / count(DISTINCT doc), 6) AS avg_field_length FROM p GROUP BY field")
def g7(spark, sf_dir):
    return P.average_lengths(documents_index(spark, sf_dir, segments=2).lengths()).select("field", F.round("avg_field_length", 6).alias("avg_field_length"))


@query("g8_doc_count", "SELECT doc_id % 2 AS seg, count(*) AS docs FROM documents GROUP BY 1")
def g8(spark, sf_dir):
    return documents_index(spark, sf_dir, segments=2).docs.groupBy(F.col("seg").cast("bigint").alias("seg")).agg(F.count("*").alias("docs"))


THAT, THIS, WAS, EN = ("text", "that"), ("text", "this"), ("text", "was"), ("lang", "en")


@query("f1_term", search_sql([THAT], "t0"))
def f1(spark, sf_dir):
    return found(documents_index(spark, sf_dir), "that")


@query("f2_multi_token", search_sql([THAT, WAS], "t0 AND t1"))
def f2(spark, sf_dir):
    return found(documents_index(spark, sf_dir), '"that, the was!"')


@query("f3_keyword", search_sql([EN, ("_id", "7")], "t0 OR t1"))
def f3(spark, sf_dir):
    return found(documents_index(spark, sf_dir), "lang:en OR _id:7")


@query("f4_and", search_sql([THAT, THIS], "t0 AND t1"))
def f4(spark, sf_dir):
    return found(documents_index(spark, sf_dir), "that AND this")


@query("f5_or", search_sql([THAT, THIS], "t0 OR t1"))
def f5(spark, sf_dir):
    return found(documents_index(spark, sf_dir), "that OR this")


@query("f6_match_all", "SELECT doc_id, 0.0::DOUBLE AS score FROM documents")
def f6(spark, sf_dir):
    return found(documents_index(spark, sf_dir), " ")


@query("f7_match_none", "SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE false")
def f7(spark, sf_dir):
    return found(documents_index(spark, sf_dir), "the that")


@query("fx_nested", search_sql([THAT, THIS, WAS, EN], "t0 AND (t1 OR t2) AND t3"))
def fx_nested(spark, sf_dir):
    return found(documents_index(spark, sf_dir), "that AND (this OR was) lang:en")


@query("fx_stray_leaf", search_sql([THAT, THIS, WAS], "(t0 AND t1) OR t2"))
def fx_stray(spark, sf_dir):
    return found(documents_index(spark, sf_dir), "(that this) OR was")


@query("fx_repeated_leaf", search_sql([THAT, THIS], "t0", [0, 1, 0]).replace("WHERE t0)", "WHERE t0 OR t1)"))
def fx_repeated(spark, sf_dir):
    return found(documents_index(spark, sf_dir), "that OR this OR that")


@query("fx_two_fields", search_sql([("p_name", "widget"), ("p_type", "small"), ("p_brand", "Brand#17")], "t0 OR t1 OR t2", post=PART_POST))
def fx_two_fields(spark, sf_dir):
    return found(parts_index(spark, sf_dir), 'widget OR p_type:small OR p_brand:"Brand#17"', "p_name")


@query("j1_intersect", f"WITH {POST} SELECT a.doc AS doc_id, (a.tf + b.tf)::BIGINT AS freq FROM p a JOIN p b ON a.doc = b.doc WHERE a.field = 'text' AND b.field = 'text' AND a.term = 'that' AND b.term = 'this'")
def j1(spark, sf_dir):
    p = documents_index(spark, sf_dir).postings.where("field = 'text'")
    return P.intersect([p.where("term = 'that'"), p.where("term = 'this'")]).select(F.col("doc").alias("doc_id"), "freq")


@query("j2_unite", f"WITH {POST} SELECT doc AS doc_id, sum(tf)::BIGINT AS freq FROM p WHERE field = 'text' AND term IN ('that', 'this') GROUP BY doc")
def j2(spark, sf_dir):
    p = documents_index(spark, sf_dir).postings.where("field = 'text'")
    return P.unite([p.where("term = 'that'"), p.where("term = 'this'")]).select(F.col("doc").alias("doc_id"), "freq")


@query("s2_advance", f"WITH {POST} SELECT min(doc) AS doc_id FROM p WHERE field = 'text' AND term = 'that' AND doc >= 100")
def s2(spark, sf_dir):
    p = documents_index(spark, sf_dir).postings.where("field = 'text' and term = 'that'")
    return P.advance(p, 100).select(F.col("doc").alias("doc_id"))


@query("x1_idf", f"WITH {POST} SELECT field, term, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM p, n GROUP BY field, term")
def x1(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    stats = index.term_stats().crossJoin(F.broadcast(index.docs.agg(F.count("*").alias("n"))))
    return stats.select("field", "term", F.round(scoring.bm25_idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(
    "x2_bm25_lengths",
    f"""WITH {POST}, l AS (SELECT doc, sum(tf) AS len FROM p WHERE field = 'text' GROUP BY doc), g AS (SELECT avg(len) AS avg FROM l), d AS (SELECT count(*) AS d FROM p WHERE field = 'text' AND term = 'that')
SELECT p.doc AS doc_id, round(ln((n - d + 0.5) / (d + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg)), 6) AS score FROM p JOIN l USING (doc), g, d, n WHERE field = 'text' AND term = 'that'""",
)
def x2(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    own = index.postings.where("field = 'text'").groupBy("doc").agg(F.sum("tf").alias("len"), F.max(F.when(F.col("term") == "that", F.col("tf"))).alias("tf"))
    # over the same aggregation as the rows, whose exchange then serves both
    stats = own.agg(F.avg("len").alias("avg"), F.count("tf").alias("d")).crossJoin(index.docs.agg(F.count("*").alias("n")))
    rows = own.where("tf is not null").crossJoin(F.broadcast(stats))
    score = scoring.bm25_score(scoring.bm25_idf(F.col("n"), F.col("d")), F.col("tf"), F.col("len"), F.col("avg"))
    return rows.select(F.col("doc").alias("doc_id"), F.round(score, 6).alias("score"))


@query("x3_quantize", "SELECT l_orderkey, l_linenumber, (CASE WHEN w <= 0 THEN 0 WHEN w >= 8 THEN 255 ELSE floor(w * 255 / 8 + 0.5) END)::SMALLINT AS q FROM (SELECT l_orderkey, l_linenumber, l_quantity / 5 - 1 AS w FROM lineitem)")
def x3(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scoring.quantize_weight(F.col("l_quantity") / 5 - 1).alias("q"))


@query("x4_decay", f"WITH {POST}, a AS (SELECT sum(tf) / count(DISTINCT doc) AS avg FROM p WHERE field = 'text') SELECT doc AS doc_id, term, round(exp(-0.5 * first_pos / avg), 6) AS decay FROM p, a WHERE field = 'text'")
def x4(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    own = index.postings.where("field = 'text'")
    avg = P.average_lengths(index.lengths()).where("field = 'text'").select("avg_field_length")
    return own.crossJoin(F.broadcast(avg)).select(F.col("doc").alias("doc_id"), "term", F.round(scoring.position_decay(F.lit(0.5), F.col("first_pos"), F.col("avg_field_length")), 6).alias("decay"))


TOP = search_sql([THAT, THIS, WAS], "t0 AND (t1 OR t2)")


@query("t1_topk", f"{TOP} ORDER BY score DESC, doc_id LIMIT 10")
def t1(spark, sf_dir):
    return found(documents_index(spark, sf_dir), "that AND (this OR was)").orderBy(F.desc("score"), "doc_id").limit(10)


@query("g10_total_hits", f"SELECT count(*) AS total FROM ({TOP})")
def g10(spark, sf_dir):
    return S.total_hits(documents_index(spark, sf_dir), Q.parse("that AND (this OR was)", "text"))


@query("j7_hydrate", f"SELECT t.doc_id::VARCHAR AS _id, t.score, d.source FROM ({TOP} ORDER BY score DESC, doc_id LIMIT 25) t JOIN documents d ON d.doc_id = t.doc_id")
def j7(spark, sf_dir):
    rows = S.hits(documents_index(spark, sf_dir), Q.parse("that AND (this OR was)", "text"), S.Options(size=25))
    return rows.select("_id", F.round("score", 6).alias("score"), F.get_json_object("stored", "$.source").alias("source"))


@query("f9_stored_fields", "SELECT p_partkey::VARCHAR AS _id, p_name, p_brand, CAST(NULL AS VARCHAR) AS p_type FROM part")
def f9(spark, sf_dir):
    docs = parts_index(spark, sf_dir).docs
    return docs.select(*(F.get_json_object("stored", f"$.{n}").alias(n) for n in ("_id", "p_name", "p_brand", "p_type")))


@query("f11_json_text", "SELECT event_id::VARCHAR AS _id, printf('%.6f', value) AS value, event_type, CASE WHEN value > 50 THEN 'true' ELSE 'false' END AS big FROM events")
def f11(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumns({"_id": F.col("event_id").cast("string"), "big": F.col("value") > 50, "list": F.array("event_id")})
    lines = events.select(F.to_json(F.struct("_id", "value", "event_type", "big", "list")).alias("value"))
    schema = Schema.from_mappings({"mappings": {"value": {}, "event_type": {}, "big": {}, "list": {}}})
    return D.typed(lines, schema).where("list is null").select("_id", "value", "event_type", "big")


FEATURE_LEAVES = [THAT, EN, WAS]


def _features_sql() -> str:
    bm = [f"(i{i} * tf{i} * (1.2 + 1) / (tf{i} + 1.2))" for i in range(3)]
    boost, order = (1.5, 2.0, 1.5), (0, 1, 2, 0)
    total = lambda f, keep=(0, 1, 2): "0.0::DOUBLE + " + " + ".join(f"CASE WHEN t{i} THEN {f(i)} ELSE 0.0 END" if i in keep else "0.0" for i in order)
    least = lambda pick, f: f"coalesce({pick}({', '.join(f'CASE WHEN t{i} THEN {f(i)} END' for i in order)}), 0.0)"
    matched = " + ".join(f"CASE WHEN t{i} THEN 1 ELSE 0 END" for i in order)
    cols = [
        total(lambda i: f"{bm[i]} * {boost[i]}"), total(lambda i: f"tf{i}"), total(lambda i: f"i{i}"), matched, "4", f"({matched})::FLOAT / 4::FLOAT", "0", "0", "0",
        total(lambda i: f"{bm[i]} * {boost[i]}", (1,)), "0", total(lambda i: f"{bm[i]} * {boost[i]}", (0, 2)), total(lambda i: f"exp(-0.5 * fp{i} / avg)", (0, 2)), total(lambda i: "1.0"),
        f"CASE WHEN ({matched}) > 0 THEN 1 ELSE 0 END", "coalesce(q, 0)", least("least", lambda i: f"i{i}"), least("greatest", lambda i: f"i{i}"),
        f"coalesce(least({', '.join(f'CASE WHEN t{i} THEN fp{i} / avg END' for i in (0, 2, 0))}), 0.0)",
    ]
    out = ", ".join(f"round((({c})::FLOAT)::DOUBLE, 4) AS {n}" for c, n in zip(cols, features.NAMES))
    return f"WITH {matched_sql(FEATURE_LEAVES, 't0 OR t1 OR t2')}, a AS (SELECT sum(tf) / count(DISTINCT doc) AS avg FROM p WHERE field = 'text'), lab AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) SELECT doc AS doc_id, {out} FROM m LEFT JOIN lab ON lab.doc_id = m.doc, a"


def _feature_rows(spark, sf_dir) -> DataFrame:
    return S.candidates(documents_index(spark, sf_dir, quality=True), Q.parse("that OR lang:en OR was OR that", "text"), features_too=True)


@query("g11_features", _features_sql())
def g11(spark, sf_dir):
    return _feature_rows(spark, sf_dir).select(F.col("doc").alias("doc_id"), *(F.round(F.col("features")[i].cast("double"), 4).alias(n) for i, n in enumerate(features.NAMES)))


def _reranked(spark, sf_dir, ranker, size=20, top=200) -> DataFrame:
    rows = S.hits(documents_index(spark, sf_dir, quality=True), Q.parse("that OR lang:en OR was OR that", "text"), S.Options(size, top, ranker))
    return rows.select(F.col("doc").alias("doc_id"), F.round("score", 4).alias("score"))


def _rerank_sql(expr: str) -> str:
    inner = _features_sql().replace("SELECT doc AS doc_id,", f"SELECT {score_sql(FEATURE_LEAVES, [0, 1, 2, 0])} AS bm, doc AS doc_id,")
    for n in features.NAMES:  # the ranker sees what isn't rounded
        inner = inner.replace(f"::FLOAT)::DOUBLE, 4) AS {n}", f"::FLOAT)::DOUBLE, 15) AS {n}")
    return f"SELECT doc_id, round(({expr})::FLOAT::DOUBLE, 4) AS score FROM (SELECT * FROM ({inner}) ORDER BY bm DESC, doc_id LIMIT 200) ORDER BY ({expr})::FLOAT DESC, doc_id LIMIT 20"


@query("e2_bm25_ranker", _rerank_sql("bm25_total"))
def e2(spark, sf_dir):
    return _reranked(spark, sf_dir, Bm25Ranker())


@query("e3_linear_ranker", _rerank_sql("0.25 + bm25_total + 3.0 * position_decay_sum + 5.0 * doc_quality"))
def e3(spark, sf_dir):
    return _reranked(spark, sf_dir, LinearRanker(WEIGHTS, 0.25))


@query("e4_model_ranker", _rerank_sql("tf_sum * 2 + doc_quality"))
def e4(spark, sf_dir):
    return _reranked(spark, sf_dir, ModelRanker(lambda x: x[:, 1] * 2 + x[:, 15]))


_TWO = [("q1", "that AND (this OR was)"), ("q2", "lang:fr OR this"), ("q3", "the this")]


def _many_sql(top: int) -> str:
    one = TOP.replace("AS score FROM m", "AS score, 'q1' AS query_id FROM m")
    two = search_sql([("lang", "fr"), THIS], "t0 OR t1").replace("AS score FROM m", "AS score, 'q2' AS query_id FROM m")
    return f"SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, score FROM ({one}) UNION ALL SELECT query_id, doc_id, score FROM ({two}))) WHERE rank <= {top}"


@query("w3_topn_per_query", _many_sql(50))
def w3(spark, sf_dir):
    rows = S.search_many(documents_index(spark, sf_dir), _TWO, "text", top=50)
    return rows.select("query_id", "rank", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


JUDGED = "SELECT 'q1' AS query_id, doc_id, quality + 2 * toxic AS label FROM labels UNION ALL SELECT 'q2', doc_id, 1 - quality FROM labels UNION ALL SELECT 'q3', doc_id, toxic FROM labels"


def _judgments(spark, sf_dir) -> DataFrame:
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    three = F.array(F.struct(F.lit("q1").alias("query_id"), (F.col("quality") + 2 * F.col("toxic")).alias("label")), F.struct(F.lit("q2").alias("query_id"), (1 - F.col("quality")).alias("label")), F.struct(F.lit("q3").alias("query_id"), F.col("toxic").alias("label")))
    return labels.select(F.col("doc_id").alias("id"), F.inline(three))


@query(
    "x14_quality",
    f"""WITH h AS ({_many_sql(10)}), j AS ({JUDGED}), g AS (SELECT h.query_id, h.rank, coalesce(j.label, 0) AS label FROM h LEFT JOIN j ON j.query_id = h.query_id AND j.doc_id = h.doc_id),
got AS (SELECT query_id, sum((2 ** label - 1) / log2(rank + 1.0)) AS dcg, sum(CASE WHEN rank <= 5 AND label > 0 THEN 1 ELSE 0 END) AS r, min(CASE WHEN label > 0 THEN rank END) AS f FROM g GROUP BY query_id),
best AS (SELECT query_id, sum((2 ** label - 1) / log2(rank + 1.0)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY label DESC, doc_id) AS rank FROM j) WHERE rank <= 10 GROUP BY query_id)
SELECT query_id, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 6)::DOUBLE AS ndcg, (coalesce(r, 0) / 5)::DOUBLE AS precision, coalesce(round(1.0 / f, 6), 0)::DOUBLE AS mrr FROM best LEFT JOIN got USING (query_id)""",
)
def x14(spark, sf_dir):
    hits = S.search_many(documents_index(spark, sf_dir), _TWO, "text", top=10).select("query_id", F.col("doc").alias("id"), "rank")
    return metrics.quality(hits, _judgments(spark, sf_dir)).select("query_id", F.round("ndcg", 6).alias("ndcg"), "precision", F.round("mrr", 6).alias("mrr"))


@query("w2_rank", "SELECT event_type AS query_id, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)::INTEGER AS rank FROM events")
def w2(spark, sf_dir):
    return metrics.ranked(read(spark, sf_dir, "events").select(F.col("event_type").alias("query_id"), F.col("event_id").alias("id"), F.col("value").alias("score"))).drop("score")


@query("w4_query_ids", "SELECT event_id AS line, event_type AS query, dense_rank() OVER (ORDER BY f)::INTEGER - 1 AS query_id FROM (SELECT event_id, event_type, min(event_id) OVER (PARTITION BY event_type) AS f FROM events)")
def w4(spark, sf_dir):
    return metrics.auto_query_ids(read(spark, sf_dir, "events").select(F.col("event_id").alias("line"), F.col("event_type").alias("query"))).select("line", "query", "query_id")


_BUCKETS = "SELECT (epoch_us(ts) // 1000000)::BIGINT AS bucket, count(*) AS n FROM events GROUP BY 1"


@query("g15_buckets", f"SELECT bucket, n, e::BIGINT AS errors FROM (SELECT (epoch_us(ts) // 1000000)::BIGINT AS bucket, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1)")
def g15(spark, sf_dir):
    return metrics.buckets(read(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error"), "ts", 1, "ok")


@query("g15_percentiles", "SELECT count(*) AS n, round(avg(value), 6) AS mean, " + ", ".join(f"list_sort(list(value))[least(floor(count(*) * {p}), count(*) - 1)::BIGINT + 1] AS p{round(p * 100)}" for p in (0.5, 0.95, 0.99)) + " FROM events")
def g15p(spark, sf_dir):
    return metrics.percentiles(read(spark, sf_dir, "events"), "value").withColumn("mean", F.round("mean", 6))


@query("w5_rolling60", f"WITH b AS ({_BUCKETS}) SELECT max(s)::BIGINT AS best FROM (SELECT sum(n) OVER (ORDER BY bucket RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS s FROM b)")
def w5(spark, sf_dir):
    return metrics.best_rolling(metrics.buckets(read(spark, sf_dir, "events"), "ts"))


@query("u1_segments_union", TOP)
def u1(spark, sf_dir):
    return found(documents_index(spark, sf_dir, segments=2), "that AND (this OR was)")


_POOL_SQL = _features_sql().replace("SELECT doc AS doc_id,", "SELECT doc AS doc_id,")


@query("j9_pool", f"WITH f AS ({_POOL_SQL}), l AS (SELECT doc_id, max(quality) AS label FROM labels GROUP BY doc_id) SELECT l.label, 3 AS query_id, " + ", ".join(f"coalesce({n}, 0.0) AS f{i}" for i, n in enumerate(features.NAMES)) + " FROM l LEFT JOIN f USING (doc_id)")
def j9(spark, sf_dir):
    judged = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("label")).select(F.lit("that OR lang:en OR was OR that").alias("query"), F.col("doc_id").cast("string").alias("doc_id"), "label", F.lit(3).alias("query_id"))
    rows = pool(documents_index(spark, sf_dir, quality=True), judged, "text", None)
    return rows.select("label", "query_id", *(F.round(F.col(f"f{i}").cast("double"), 4).alias(f"f{i}") for i in range(features.COUNT)))


@query("k1_stored_index", search_sql([("p_name", "widget"), ("p_type", "small")], "t0 OR t1", post=PART_POST).replace("doc AS doc_id", "doc::VARCHAR AS _id"))
def k1(spark, sf_dir):
    parts = read(spark, sf_dir, "part").withColumn("_id", F.col("p_partkey").cast("string"))
    index = index_frame(parts.select("_id", "p_name", "p_type", "p_brand"), parts_index(spark, sf_dir).schema, shared.folder(spark))
    rows = S.candidates(index, Q.parse("widget OR p_type:small", "p_name"))
    return rows.join(index.docs, ["seg", "doc"]).select("_id", F.round("score", 6).alias("score"))


@query("r2s_refresh", search_sql([("p_name", "widget"), ("p_type", "small")], "t0 OR t1", post=PART_POST).replace("doc AS doc_id", "doc::VARCHAR AS _id"))
def r2s(spark, sf_dir):
    """Two refreshes of the writer: the table's halves land as JSON lines, and each becomes a segment."""
    root = shared.folder(spark)
    writer = IndexWriter(spark, root, parts_index(spark, sf_dir).schema)
    rows = read(spark, sf_dir, "part").select(F.pmod("p_partkey", F.lit(2)).alias("half"), F.to_json(F.struct(F.col("p_partkey").cast("string").alias("_id"), "p_name", "p_type", "p_brand")).alias("value"))
    for half in (0, 1):
        writer.land(rows.where(F.col("half") == half).select("value"))
        writer.refresh()
    index = writer.reader()
    return S.candidates(index, Q.parse("widget OR p_type:small", "p_name")).join(index.docs, ["seg", "doc"]).select("_id", F.round("score", 6).alias("score"))


def _stored(spark, sf_dir) -> P.Index:
    """The documents with their qualities as an index on disk, read again."""
    root = shared.folder(spark)
    index_frame(corpus(spark, sf_dir, quality=True), Schema.from_mappings(MAPPING), root)
    return store.open_index(spark, root)


@query("k2_stored_features", _features_sql())
def k2(spark, sf_dir):
    index = _stored(spark, sf_dir)
    rows = S.candidates(index, Q.parse("that OR lang:en OR was OR that", "text"), features_too=True).join(index.docs.select("seg", "doc", "_id"), ["seg", "doc"])
    return rows.select(F.col("_id").cast("bigint").alias("doc_id"), *(F.round(F.col("features")[i].cast("double"), 4).alias(n) for i, n in enumerate(features.NAMES)))


@query("k6_stored_quality", "SELECT d.doc_id::VARCHAR AS _id, coalesce(l.q, 0)::FLOAT AS quality, d.source FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l USING (doc_id)")
def k6(spark, sf_dir):
    return _stored(spark, sf_dir).docs.select("_id", "quality", F.get_json_object("stored", "$.source").alias("source"))


@query("f8_default_field", search_sql([THAT, THIS], "t0 AND t1"))
def f8(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return found(index, "that this", index.schema.default_field())


@query("e8_other_k1", search_sql([THAT, THIS], "t0 OR t1").replace("1.2", "2.0"))
def e8(spark, sf_dir):
    return S.candidates(documents_index(spark, sf_dir), Q.parse("that OR this", "text"), k1=2.0).select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query("x17_printed_trees", """SELECT * FROM (VALUES ('a b', '(text:a AND text:b)'), ('a OR b c', '(text:a OR (text:b AND text:c))'), ('(a OR lang:en) AND b', '((text:a OR lang:en) AND text:b)'), ('', '*'), ('t:"x y"', 't:x y')) AS v(query, tree)""")
def x17(spark, sf_dir):
    return spark.createDataFrame([(q, str(Q.parse(q, "text"))) for q in ("a b", "a OR b c", "(a OR lang:en) AND b", "", 't:"x y"')], "query string, tree string")


@query("p1_searcher", f"WITH x AS ({TOP}) SELECT doc_id::VARCHAR AS _id, score, source, (SELECT count(*) FROM x) AS total FROM x JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10")
def p1(spark, sf_dir):
    got = S.Searcher(documents_index(spark, sf_dir)).search("that AND (this OR was)", "text", size=10)
    return spark.createDataFrame([(h.id, round(h.score, 6), json.loads(h.stored_json)["source"], got.total_hits) for h in got.hits], "_id string, score double, source string, total bigint")


@query("p10_search_route", search_sql([("p_name", "widget"), ("p_type", "small")], "t0 OR t1", post=PART_POST).replace("doc AS doc_id", "doc::VARCHAR AS _id") + " ORDER BY score DESC, doc LIMIT 1000")
def p10(spark, sf_dir):
    """An index is made, filled, refreshed and searched through the service's routes."""
    service = SearchService(spark, shared.folder(spark))
    body = {"mappings": {"p_name": {"type": "text", "stored": True}, "p_type": {"type": "text"}}}
    assert service.handle(Request("PUT", "/parts", json.dumps(body).encode())).status == 200
    rows = read(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.col("p_partkey").cast("string").alias("_id"), "p_name", "p_type")).alias("value"))
    service.writers["parts"].land(rows.orderBy("p_partkey").coalesce(1))
    assert service.handle(Request("POST", "/parts/_refresh")).body["refreshed"]
    got = service.handle(Request("GET", "/parts/_search?q=widget%20OR+p_type%3Asmall&default_field=p_name&size=5000"))
    return spark.createDataFrame([(h["_id"], round(h["_score"], 6)) for h in got.body["hits"]], "_id string, score double")


@query("p6_routes", """SELECT * FROM (VALUES
  ('GET /_health', 200, NULL), ('PUT /a', 200, NULL), ('PUT /a', 409, 'already_exists'), ('PUT /a b', 400, 'invalid_index_name'), ('PUT /c {', 400, 'bad_request'), ('POST /a/_doc', 201, NULL), ('POST /a/_doc []', 400, 'bad_request'), ('POST /a/_doc no id', 400, 'bad_request'),
  ('POST /x/_doc', 404, 'not_found'), ('POST /a/_refresh', 200, NULL), ('GET /a/_search', 200, NULL), ('GET /a/_search (', 400, 'bad_request'), ('GET /a/_search size', 400, 'bad_request'), ('GET /x/_search', 404, 'not_found'),
  ('GET /a/_ltr', 200, NULL), ('PUT /a/_ltr/linear', 200, NULL), ('PUT /a/_ltr/linear 3', 400, 'bad_request'), ('DELETE /a', 405, 'method_not_allowed'), ('GET /a/b/c', 404, 'not_found')) AS v(route, status, type)""")
def p6(spark, sf_dir):
    service = SearchService(spark, shared.folder(spark))
    schema, doc = b'{"mappings": {"t": {}}}', b'{"_id": "1", "t": "x"}'
    calls = (
        ("GET /_health", "/_health", b""), ("PUT /a", "/a", schema), ("PUT /a", "/a", schema), ("PUT /a b", "/a%20b", schema), ("PUT /c {", "/c", b"{"), ("POST /a/_doc", "/a/_doc", doc), ("POST /a/_doc []", "/a/_doc", b"[]"), ("POST /a/_doc no id", "/a/_doc", b"{}"),
        ("POST /x/_doc", "/x/_doc", doc), ("POST /a/_refresh", "/a/_refresh", b""), ("GET /a/_search", "/a/_search?q=x", b""), ("GET /a/_search (", "/a/_search?q=(", b""), ("GET /a/_search size", "/a/_search?q=x&size=-1", b""), ("GET /x/_search", "/x/_search?q=x", b""),
        ("GET /a/_ltr", "/a/_ltr", b""), ("PUT /a/_ltr/linear", "/a/_ltr/linear", json.dumps({"weights": [0.0] * features.COUNT}).encode()), ("PUT /a/_ltr/linear 3", "/a/_ltr/linear", b'{"weights": [1, 2, 3]}'), ("DELETE /a", "/a", b""), ("GET /a/b/c", "/a/b/c", b""),
    )
    rows = []
    for name, target, body in calls:
        got = service.handle(Request(name.split()[0], target, body))
        rows.append((name, got.status, got.body["error"]["type"] if "error" in got.body else None))
    return spark.createDataFrame(rows, "route string, status int, type string")


@query("r3s_snapshots", "SELECT * FROM (SELECT 'empty' AS moment, 0 AS docs UNION ALL SELECT 'pending', 0 UNION ALL SELECT 'first', count(*) FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'first, later', count(*) FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'reopened', count(*) FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'recovered', count(*) FROM nation)")
def r3s(spark, sf_dir):
    """Documents added one by one; a snapshot stays as it was; what was logged before a crash is there after it."""
    root, schema = shared.folder(spark), Schema.from_mappings({"mappings": {"n_name": {"stored": True}}})
    nations = [(r.n_nationkey, {"_id": str(r.n_nationkey), "n_name": r.n_name}) for r in read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    writer, out = IndexWriter(spark, root, schema), []
    out.append(("empty", writer.reader().doc_count()))
    writer.add_documents([d for k, d in nations if k % 2 == 0], [json.dumps(d, indent=1) for k, d in nations if k % 2 == 0])
    out.append(("pending", writer.reader().doc_count()))
    writer.refresh()
    first = writer.reader()
    out.append(("first", first.doc_count()))
    for k, d in nations:
        if k % 2:
            writer.add_document(d)
    del writer  # as in a crash: neither refreshed nor closed
    again = IndexWriter(spark, root)
    out.append(("reopened", again.reader().doc_count()))
    again.refresh()
    out += [("recovered", again.reader().doc_count()), ("first, later", first.doc_count())]
    return spark.createDataFrame(out, "moment string, docs bigint")


@query("g14_mean_quality", f"SELECT round(avg(ndcg), 5) AS ndcg, round(avg(precision), 5) AS precision, round(avg(mrr), 5) AS mrr FROM ({SQL['x14_quality']})")
def g14(spark, sf_dir):
    return metrics.mean_quality(x14(spark, sf_dir)).select(*(F.round(c, 5).alias(c) for c in ("ndcg", "precision", "mrr")))


@query("k11_quality_report", f"SELECT count(*) AS queries, round(avg(ndcg), 4) AS ndcg, round(avg(precision), 4) AS precision, round(avg(mrr), 4) AS mrr FROM ({SQL['x14_quality']}) WHERE query_id IN ('q1', 'q2')")
def k11(spark, sf_dir):
    asked = spark.createDataFrame(_TWO[:2], "query_id string, query string")
    judged = _judgments(spark, sf_dir).join(F.broadcast(asked), "query_id").select("query", F.col("id").cast("string").alias("doc_id"), "label")  # two rows
    got = report.quality_report(spark, report.engine(documents_index(spark, sf_dir), "text"), judged)
    return spark.createDataFrame([(got["queries"], round(got["ndcg@10"], 4), round(got["p@5"], 4), round(got["mrr"], 4))], "queries bigint, ndcg double, precision double, mrr double")


@query("k8_pool_file", "SELECT max(quality)::VARCHAR AS label, '3' AS query_id, 21 AS columns, count(*) OVER () AS rows FROM labels GROUP BY doc_id")
def k8(spark, sf_dir):
    judged = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("label")).select(F.lit("that AND was").alias("query"), F.col("doc_id").cast("string").alias("doc_id"), "label", F.lit(3).alias("query_id"))
    path = f"{shared.folder(spark)}/pool"
    write_pool(pool(documents_index(spark, sf_dir, quality=True), judged, "text"), path)
    parts = F.split("value", "\t", -1)
    lines = spark.read.text(path).select(parts[0].alias("label"), parts[1].alias("query_id"), F.size(parts).alias("columns"))
    return lines.crossJoin(F.broadcast(lines.agg(F.count("*").alias("rows"))))


def _lines(spark, rows: DataFrame) -> str:
    """Lines of text written to the shared folder."""
    path = f"{shared.folder(spark)}/lines"
    rows.select("value").write.text(path)
    return path


@query("s10_judgments", "SELECT 'q' || doc_id % 7 AS query, doc_id::VARCHAR AS doc_id, quality::INTEGER AS label, CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 END AS query_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL")
def s10(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    good = labels.select(F.to_json(F.struct(F.concat(F.lit("q"), F.col("doc_id") % 7).alias("query"), F.col("doc_id").cast("string").alias("doc_id"), (F.col("quality") + 0.9).alias("label"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 7).alias("query_id"))).alias("value"))
    broken = labels.select(F.concat(F.lit('{"query": "q", "label": 1, "doc_id": '), F.col("doc_id")).alias("value"))
    return D.read_judgments(spark, _lines(spark, good.unionByName(broken))).drop("line")


@query("s16_query_list", "SELECT CASE WHEN item_id % 3 = 1 THEN 'title' END AS field, 'word' || item_id AS query FROM benchmark WHERE item_id % 3 > 0")
def s16(spark, sf_dir):
    item = F.col("item_id")
    rows = read(spark, sf_dir, "benchmark").select(F.when(item % 3 == 0, F.concat(F.lit("# word"), item)).when(item % 3 == 1, F.concat(F.lit("title\tword"), item)).otherwise(F.concat(F.lit("  word"), item, F.lit(" \n"))).alias("value"))
    return D.read_queries(spark, _lines(spark, rows))


@query("s17_corpus", "SELECT p_partkey::VARCHAR AS _id, p_name FROM part")
def s17(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.to_json(F.struct(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).alias("_id"), F.when(F.col("p_partkey") % 2 == 1, F.col("p_partkey")).alias("id"), "p_name")).alias("value"))
    return D.read_corpus(spark, _lines(spark, rows)).select("_id", "p_name")


@query("s9_mapping", "SELECT * FROM (VALUES (0, '_id', 'keyword', 'keyword', true, 1.0, 0.0), (1, 'lang', 'keyword', 'keyword', false, 2.0, 0.0), (2, 'source', 'keyword', 'keyword', true, 1.0, 0.0), (3, 'text', 'text', 'standard', false, 1.5, 0.5)) AS v(place, name, type, analyzer, stored, boost, position_decay)".replace("1.0, 0.0", "1.0::DOUBLE, 0.0::DOUBLE").replace("2.0, 0.0", "2.0::DOUBLE, 0.0::DOUBLE").replace("1.5, 0.5", "1.5::DOUBLE, 0.5::DOUBLE"))
def s9(spark, sf_dir):
    path = f"{shared.folder(spark)}/mapping.json"
    Files(spark).write(path, json.dumps(MAPPING))
    schema = D.read_mapping(path, spark)
    return spark.createDataFrame([(i, f.name, f.type, f.analyzed_by, f.stored, f.boost, f.position_decay) for i, f in enumerate(schema.fields)], "place int, name string, type string, analyzer string, stored boolean, boost double, position_decay double")
