import glob
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidewater import queries
from tidewater.functions import analysis
from tidewater.operators import postings as P
from tidewater.plans.schema import Schema
from tidewater.sources import store
from tidewater.streaming.writer import index_frame

DATA = "/root/testdata/sf0.001"
MAPPING = {"mappings": {"text": {"type": "text", "store_token_weights": True}, "title": {"type": "text"}, "lang": {"type": "keyword"}}, "store_doc_quality": True}
ROWS = [
    (1, "River the river stone", "a River", "en", [0.5, 3.0, 9.0]),
    (2, None, "", "", None),
    (2, "stone Light", "light light", "fr", [4.0]),
    (2, "light harbor light stone", None, "fr", None),
    (3, "the of", "of mill", None, [1.0]),
    (None, "mill", "mill boat", "en", None),
    (None, "boat mill", None, "en", [2.0, float("nan")]),
    (5, "", "é-x", "en", []),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "n bigint, text string, title string, lang string, text_weights array<float>").withColumn("_id", F.col("n").cast("string"))


def plan(df) -> str:
    """The plan that ran, once it has, else the first one."""
    return df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]


def loops(rows):
    out = {}
    for n, text, title, lang, weights in rows:
        for field, value in (("_id", None if n is None else str(n)), ("text", text), ("title", title), ("lang", lang)):
            for i, t in enumerate(analysis.analyze(value or "", "standard" if field in ("text", "title") else "keyword")):
                p = out.setdefault((n, field, t), [0, i, None])
                w = None if field != "text" else weights[i] if weights and i < len(weights) else 1.0
                p[0], p[1] = p[0] + 1, min(p[1], i)
                p[2] = w if p[2] is None or w is not None and (w != w or w > p[2]) else p[2]
    q8 = lambda w: None if w is None else 255 if w != w or w >= 8 else int(w * 255 / 8 + 0.5) if w > 0 else 0
    return {k: (tf, at, q8(w)) for k, (tf, at, w) in out.items()}


def test_rows_of_one_number_are_one_document(spark):
    index = P.build(frame(spark), Schema.from_mappings(MAPPING), 0, F.col("n"))
    rows = index.postings.collect()
    assert {(r.doc, r.field, r.term): (r.tf, r.first_pos, r.weight_q8) for r in rows} == loops(ROWS) and len(rows) == len(loops(ROWS))
    want = defaultdict(lambda: [set(), 0, set()])
    for (n, field, term), (tf, *_) in loops(ROWS).items():
        want[field][0].add(n)
        want[field][1] += tf
        want[field][2].add(term)
    assert {r.field: (r.doc_count, r.sum_field_length, r.term_count) for r in index.field_stats().collect()} == {f: (len(a), b, len(c)) for f, (a, b, c) in want.items()}


def test_counts_in_parts(monkeypatch):
    words = pa.array([["b", "a", "b"], None, [], ["a"], ["c", None, "c", "b"], [None], ["d"] * 9])
    weights = pa.array([[1.0, 5.0, 2.0], None, [], [0.5], [1.0, 9.0, -1.0, 0.0], [3.0], [float(i) for i in range(9)]], pa.list_(pa.float32()))
    want = [[(1, 1, 5.0), (0, 2, 2.0)], [], [], [(0, 1, 0.5)], [(3, 1, 0.0), (0, 2, 1.0)], [], [(0, 9, 8.0)]]
    for size in (1, 2, 4, 7, 100):
        monkeypatch.setattr(analysis, "COUNTED_AT_ONCE", size)
        for tokens, given in ((words, weights), (words.slice(3), weights.slice(3)), (words.slice(0, 0), weights.slice(0, 0))):
            expected = want[len(words) - len(tokens) :] if len(tokens) else []
            assert [sorted((x["pos"], x["tf"], x["weight"]) for x in r) for r in analysis._weighed(tokens, given).to_pylist()] == [sorted(r) for r in expected]
            assert [sorted((x["pos"], x["tf"]) for x in r) for r in analysis._counts(tokens).to_pylist()] == [sorted(x[:2] for x in r) for r in expected]


def test_f3_texts_are_analyzed_in_parts(monkeypatch):
    texts = ["River the RIVER", None, "", "x", "y-x y", "the", "é\u212a\u0130i stone's 9A9a \U0001f600b", "a b", "b", "\n\t", "Z" * 50, "aé", "éa"]
    for size in (1, 3, 8, 40, 1 << 22):
        monkeypatch.setattr(analysis, "ANALYZED_AT_ONCE", size)
        for rows in (pa.array(texts), pa.array(texts).slice(3), pa.array(texts).slice(2, 5), pa.array(texts).slice(1, 2), pa.array(texts, pa.large_string()).slice(4), pa.array([], pa.string())):
            for row, text in zip(analysis._text_in_parts(rows, "f", 1.0, 1).to_pylist(), rows.to_pylist(), strict=True):
                words = analysis.analyze(text or "")
                assert sorted(tuple(x.values()) for x in row) == sorted(("f", w, words.count(w), min(words.index(w), 1), 1.0) for w in set(words))
    assert analysis._text_in_parts(pa.array(["b"]), "f", None, 5).to_pylist()[0][0]["weight"] is None


def test_f1_a_segments_postings_are_counted_in_their_rows_and_a_common_term_is_no_task_of_its_own(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").cast("string").alias("_id"), F.lit("en").alias("lang"), F.col("id").alias("order"))
    schema = Schema.from_mappings({"mappings": {"lang": {"type": "keyword"}}}).with_id()
    assert store.seal(docs, schema, str(tmp_path), 7, "s", partitions=8) == 4000
    files = [pq.read_table(f).to_pylist() for f in sorted(glob.glob(f"{tmp_path}/segments/s/postings/*.parquet"))]
    assert sum(any(r["term"] == "en" for r in f) for f in files) > 2
    assert all([(r["term"], r["field"], r["doc"]) for r in f] == sorted((r["term"], r["field"], r["doc"]) for r in f) for f in files)
    assert len({(r["seg"], r["doc"]) for f in files for r in f if r["field"] == "lang"}) == 4000 and {r["seg"] for f in files for r in f} == {7}


def test_f2_lengths_and_term_from_one_pass(spark):
    df = queries.QUERIES["x2_bm25_lengths"](spark, DATA)
    df.collect()
    assert plan(df).count("ArrowEvalPython") == 1 and "Join" not in plan(df).replace("NestedLoopJoin", "")


def test_f3_a_segments_lengths_come_from_its_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "_lengths", None)  # from postings, which would be grouped by document
    index = index_frame(frame(spark).withColumn("_id", F.monotonically_increasing_id().cast("string")).drop("n"), Schema.from_mappings(MAPPING), str(tmp_path / "i"))
    assert {(r.field, r.doc_count, r.sum_field_length, r.term_count) for r in index.fields.collect()} == {("_id", 8, 8, 8), ("text", 5, 12, 6), ("title", 5, 7, 5), ("lang", 6, 6, 2)}


def test_f4_postings_move_nothing(spark):
    got = plan(queries.QUERIES["g1_postings"](spark, DATA))
    assert "Aggregate" not in got and "hashpartitioning" not in got


def grouped(df) -> list[str]:
    """By what a plan's exchanges divide rows."""
    return [line.partition("hashpartitioning(")[2].partition("), ")[0] for line in plan(df).splitlines() if "hashpartitioning(" in line]


def test_f5_f6_f8_statistics_of_terms_take_one_exchange_by_term(spark):
    for name, most in (("g4_term_stats", 1), ("x1_idf", 1), ("g5_global_df", 2)):
        by = grouped(queries.QUERIES[name](spark, DATA))
        assert len(by) == most and not any("doc#" in x for x in by), name


def test_f7_average_length_needs_no_postings(spark):
    got = queries.QUERIES["g7_average_length"](spark, DATA)
    assert "ArrowEvalPython" not in plan(got) and not any("doc#" in x or "term#" in x for x in grouped(got))


def test_f9_field_stats_group_nothing_by_document(spark):
    by = grouped(queries.QUERIES["g6_field_stats"](spark, DATA))
    assert by and not any("doc#" in x for x in by)


def counted(rows, seg=lambda n: 0):
    out = defaultdict(lambda: [0, 0])
    for (n, field, term), (tf, *_) in loops(rows).items():
        out[seg(n), field, term][0] += 1
        out[seg(n), field, term][1] += tf
    return {k: tuple(v) for k, v in out.items()}


def stats(rows) -> dict:
    rows = rows.collect()
    out = {(r.seg, r.field, r.term): (r.df, r.total_tf) for r in rows}
    assert len(out) == len(rows)
    return out


def test_f5_terms_are_counted_without_postings(spark, monkeypatch):
    own = [r for i, r in enumerate(ROWS) if i not in (2, 3, 5)]  # numbers are borne by one row
    schema, seg = Schema.from_mappings(MAPPING | {"mappings": MAPPING["mappings"] | {"absent": {"type": "text"}}}), F.when(F.col("n") > 1, F.col("n") % 2)
    of = lambda n: n % 2 if n is not None and n > 1 else None
    assert stats(P.build(frame(spark), schema, 0, F.col("n")).term_stats()) == counted(ROWS)  # here several rows are one document
    monkeypatch.setattr(P, "term_stats", None)
    one, parts = P.build(frame(spark, own), schema, 0, F.col("n")), P.build(frame(spark, own), schema, seg, F.col("n"))
    assert stats(one.term_stats()) == counted(own) and stats(parts.term_stats()) == counted(own, of)
    monkeypatch.setattr(analysis, "GATHERED", 2)  # handed on again and again
    assert stats(P.build(frame(spark, own), schema, seg, F.col("n")).term_stats()) == counted(own, of)
    assert stats(one.union(one).term_stats()) == {k: (2 * a, 2 * b) for k, (a, b) in counted(own).items()}
    assert stats(P.build(frame(spark, own).limit(0), schema, 0, F.col("n")).term_stats()) == {}
    terms = defaultdict(set)
    for s, f, t in counted(own, of):
        terms[s, f].add(t)
    assert {(r.seg, r.field): r.term_count for r in parts.field_stats().where("seg is not null").collect()} == {k: len(v) for k, v in terms.items() if k[0] is not None}


def test_f5_terms_are_added_up_in_parts(spark, monkeypatch):
    texts = ["River the RIVER mill", None, "", "x", "y-x y", "the", "é\u212ai stone's 9A9a", "a b", "b", "river x", "Z" * 50, "aé"] * 3
    words = [None if t is None else [None, *t.split()] for t in texts]
    batch = pa.record_batch([pa.array([i % 5 or None for i in range(len(texts))], pa.int32()), pa.array(texts), pa.array(words)], names=["seg", "c0", "c1"])
    want = defaultdict(lambda: [0, 0])
    for i, (t, w) in enumerate(zip(texts, words, strict=True)):
        for field, found in (("text", analysis.analyze(t or "")), ("own", [x for x in w or [] if x is not None])):
            for x in set(found):
                want[i % 5 or None, field, x][0] += 1
                want[i % 5 or None, field, x][1] += found.count(x)
    for size in (1, 8, 40, 1 << 22):
        monkeypatch.setattr(analysis, "ANALYZED_AT_ONCE", size)
        for rows in (analysis._added(list(analysis._terms_of(batch, ["text", "own"]))), analysis._added([analysis._added(list(analysis._terms_of(batch.slice(a, b), ["text", "own"]))) for a, b in ((0, 0), (0, 7), (7, 20), (27, 9))])):
            assert {(r["seg"], r["field"], r["term"]): [r["df"], r["total_tf"]] for r in rows.to_pylist()} == want and len(rows) == len(want)


def without_postings(df) -> bool:
    return "MapInArrow" in plan(df) and "Generate explode" not in plan(df) and "ArrowEvalPython" not in plan(df)


def test_f5_term_stats_make_no_postings(spark):
    assert all(without_postings(queries.QUERIES[name](spark, DATA)) for name in ("g4_term_stats", "g6_field_stats"))


def test_f6_idf_makes_no_postings(spark):
    assert without_postings(queries.QUERIES["x1_idf"](spark, DATA))


def test_f8_global_df_makes_no_postings(spark):
    assert without_postings(queries.QUERIES["g5_global_df"](spark, DATA))
