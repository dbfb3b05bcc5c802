import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.errors import InvalidArgument
from tidewater.functions import analysis, features, metrics, scoring
from tidewater.operators import pool as pools
from tidewater.operators import postings as P
from tidewater.operators import rankers as R
from tidewater.operators import search as S
from tidewater.plans import query as Q
from tidewater.plans.schema import Schema

MAPPING = {"mappings": {"title": {"boost": 2.0, "stored": True}, "body": {"position_decay": 0.5, "store_token_weights": True}, "tag": {"type": "keyword", "stored": True}}, "store_doc_quality": True}
SCHEMA = "_id string, title string, body string, tag string, body_weights array<float>, _quality float, noise int"
WORDS = "river harbor stone light the of mill boat".split()


def docs(n, seed=0):
    rng = random.Random(seed)
    pick = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, k)))
    return [(f"d{i}", pick(4), pick(12), rng.choice(["A b", "c", ""]), [rng.choice([0.5, 1.0, 3.0, 9.0, -1.0]) for _ in range(rng.randint(0, 12))] if i % 3 else None, rng.random() if i % 2 else None, i) for i in range(n)]


def index_of(spark, rows, segments=1):
    df = spark.createDataFrame(rows, SCHEMA)
    return P.build(df, Schema.from_mappings(MAPPING), F.col("noise") % segments, F.col("noise"))


class Plain:
    """The same by loops."""

    def __init__(self, rows):
        self.schema, self.rows = Schema.from_mappings(MAPPING), rows
        self.post = {}
        for r in rows:
            for field, value in (("_id", r[0]), ("title", r[1]), ("body", r[2]), ("tag", r[3])):
                toks = analysis.analyze(value, self.schema.get(field).type)
                for i, t in enumerate(toks):
                    p = self.post.setdefault((field, t), {}).setdefault(r[6], [0, i, 0.0])
                    p[0] += 1
                    w = r[4][i] if field == "body" and r[4] and i < len(r[4]) else 1.0
                    p[2] = max(p[2], w)

    def avg(self, field):
        lens = [len(analysis.analyze(r[{"title": 1, "body": 2}[field]])) for r in self.rows]
        lens = [x for x in lens if x]
        return sum(lens) / len(lens)

    def match(self, node, doc):
        if isinstance(node, Q.MatchAll):
            return True
        if isinstance(node, Q.Term):
            toks = Q.term_tokens(node, self.schema)
            return bool(toks) and all(doc in self.post.get((node.field, t), {}) for t in toks)
        return (all if isinstance(node, Q.And) else any)([self.match(c, doc) for c in node.children])

    def idf(self, leaf):
        return scoring.idf(len(self.rows), len(self.post.get(leaf, {})))

    def score(self, node, doc):
        out = 0.0
        for leaf in Q.leaves(node, self.schema):
            if doc in self.post.get(leaf, {}):
                tf = self.post[leaf][doc][0]
                out += self.idf(leaf) * tf * 2.2 / (tf + 1.2)
        return out

    def features(self, node, doc):
        every = Q.leaves(node, self.schema)
        f = [0.0] * 19
        f[4] = len(every)
        idfs, firsts = [], []
        for leaf in every:
            if doc not in self.post.get(leaf, {}):
                continue
            tf, pos, w = self.post[leaf][doc]
            m = self.schema.get(leaf[0])
            s = self.idf(leaf) * tf * 2.2 / (tf + 1.2) * m.boost
            f[0], f[1], f[2], f[3] = f[0] + s, f[1] + tf, f[2] + self.idf(leaf), f[3] + 1
            f[8 + self.schema.id_of(leaf[0])] += s
            if m.position_decay > 0:
                f[12] += math.exp(-m.position_decay * pos / self.avg(leaf[0]))
                firsts.append(pos / self.avg(leaf[0]))
            q = 0 if w <= 0 else 255 if w >= 8 else math.floor(w * 255 / 8 + 0.5)
            weight = q * 8 / 255 if m.store_token_weights else 1.0
            f[13] += weight
            f[14] = max(f[14], weight)
            idfs.append(self.idf(leaf))
        f[5] = f[3] / f[4] if every else 0.0
        f[15] = next(r[5] for r in self.rows if r[6] == doc) or 0.0
        if idfs:
            f[16], f[17] = min(idfs), max(idfs)
        f[18] = min(firsts, default=0.0)
        return f


QUERIES = ["", "river", "river harbor", "river OR harbor", "(river AND title:stone) OR tag:c", '"the river-boat"', "river OR the OR river", "the river", "nofield:river OR mill", 'tag:"A b" body:light', "_id:d3 OR _id:d5", "absent", "(boat OR mill) (light OR title:river) OR body:stone tag:c", "nofield:river", "title:the OR of"]


@pytest.mark.parametrize("segments", [1, 3])
def test_hits_equal_loops(spark, segments):
    rows = docs(40)
    index, plain = index_of(spark, rows, segments), Plain(rows)
    index.postings = index.postings.cache()
    for text in QUERIES:
        node = Q.parse(text, "body")
        want = {d: plain.score(node, d) for d in range(40) if plain.match(node, d)}
        got = {r.doc: r.score for r in S.candidates(index, node).collect()}
        assert got.keys() == want.keys(), text
        assert all(abs(got[d] - want[d]) < 1e-9 for d in want)
    index.postings.unpersist()


@pytest.mark.parametrize("filtered", [2000, 3])
def test_batch_equals_single(spark, monkeypatch, filtered):
    monkeypatch.setattr(S, "FILTERED_TERMS", filtered)
    rows = docs(60, 2)
    index = index_of(spark, rows, 2)
    plain = Plain(rows)
    readable = [(f"q{i}", t) for i, t in enumerate(QUERIES)]
    got = {}
    for r in S.search_many(index, readable, "body", top=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc, round(r.score, 9)))
    for qid, text in readable:
        node = Q.parse(text, "body")
        every = sorted((-round(plain.score(node, d), 9), d % 2, d) for d in range(60) if plain.match(node, d))[:7]
        assert sorted(got.get(qid, [])) == [(i + 1, d, -s) for i, (s, _, d) in enumerate(every)], text


def test_batch_takes_queries_that_masks_cannot_say(spark, monkeypatch):
    """More different terms than a mask may have, beside ordinary queries: as if searched alone. More alternatives than are written out give no masks."""
    monkeypatch.setattr(S, "MAX_LEAVES", 2)
    rows = docs(30, 4)
    index = index_of(spark, rows, 2)
    every = [("long", "river OR light OR title:stone"), ("wide", "(river OR light) AND (title:stone OR harbor)"), ("plain", "river OR light")]
    for too in (False, True):
        got = {}
        for r in S.search_many(index, every, "body", top=None, collect_features=too).collect():
            got.setdefault(r.query_id, {})[r.seg, r.doc] = (round(r.score, 9), tuple(r.features) if too else ())
        for qid, text in every:
            want = {(r.seg, r.doc): (round(r.score, 9), tuple(r.features) if too else ()) for r in S.candidates(index, Q.parse(text, "body"), too).collect()}
            assert got[qid].keys() == want.keys() and len(want) > 3
            assert all(got[qid][k][0] == want[k][0] and got[qid][k][1] == pytest.approx(want[k][1]) for k in want)
    node = Q.parse(" AND ".join(f"(w{i} OR v{i})" for i in range(13)), "body")
    bit = {x: i for i, x in enumerate(dict.fromkeys(Q.leaves(node, index.schema)))}
    assert Q.dnf(node, index.schema, bit) is None and len(Q.dnf(node, index.schema, bit, 1 << 13)) == 1 << 13


@pytest.mark.parametrize("text", ["river OR title:stone OR river OR tag:c", "nofield:x OR light", "", "title:the OR boat"])
def test_features_equal_loops(spark, text):
    rows = docs(30, 5)
    index, plain, node = index_of(spark, rows), Plain(rows), Q.parse(text, "body")
    got = {r.doc: list(r.features) for r in S.candidates(index, node, features_too=True).collect()}
    assert got
    for d, f in got.items():
        assert f == pytest.approx(plain.features(node, d), rel=1e-5, abs=1e-6)
        assert f[6] == f[7] == 0 and len(f) == len(features.NAMES)


def test_batch_features_equal_loops(spark):
    rows = docs(40, 11)
    index, plain = index_of(spark, rows, 2), Plain(rows)
    every = [(f"q{i}", t) for i, t in enumerate(QUERIES)]
    seen = set()
    for r in S.search_many(index, every, "body", 100, collect_features=True).collect():
        node = Q.parse(dict(every)[r.query_id], "body")
        assert list(r.features) == pytest.approx(plain.features(node, r.doc), rel=1e-5, abs=1e-6)
        seen.add((r.query_id, r.doc))
    assert seen == {(q, d) for q, t in every for d in range(40) if plain.match(Q.parse(t, "body"), d)}


def test_statistics(spark):
    rows = docs(20, 7)
    index, plain = index_of(spark, rows, 2), Plain(rows)
    stats = {r.field: r.avg_field_length for r in P.average_lengths(index.field_stats()).collect()}
    assert stats["body"] == pytest.approx(plain.avg("body"))
    whole = {(r.seg, r.field): (r.doc_count, r.sum_field_length) for r in index.field_stats().collect()}
    assert whole == {(r.seg, r.field): (r.doc_count, r.sum_field_length) for r in index.lengths().collect()}
    index.sizes = None
    assert whole == {(r.seg, r.field): (r.doc_count, r.sum_field_length) for r in index.lengths().collect()}
    df = {(r.field, r.term): r.df for r in P.term_stats(index.postings).groupBy("field", "term").agg(F.sum("df").alias("df")).collect()}
    assert df == {k: len(v) for k, v in plain.post.items()}
    long = [("x", " ".join(["w"] * 70_000 + ["last"]), "", "", None, None, 0)]
    p = index_of(spark, long).postings.where("term = 'last'").first()
    assert p.first_pos == 65535


def test_searcher(spark):
    rows = docs(30)
    s, plain = S.Searcher(index_of(spark, rows)), Plain(rows)
    found = s.search("river", "body", size=3)
    want = sorted((-plain.score(Q.parse("river", "body"), d), d) for d in range(30) if plain.match(Q.parse("river", "body"), d))
    assert found.total_hits == len(want) and [h.id for h in found.hits] == [f"d{d}" for _, d in want[:3]]
    assert s.search("river", "body", size=0).hits == [] and s.search("", size=2).total_hits == 30
    for nothing in ("absent", "nofield:river", "the", "river AND absent"):
        assert (s.search(nothing, "body").total_hits, s.search(nothing, "body").hits) == (0, [])
    with pytest.raises(InvalidArgument):
        s.search("a:(b)")
    weights = [0.0] * 19
    weights[15] = 100.0
    best = s.search("river", "body", S.Options(size=2, ranker=R.LinearRanker(weights), collect_features=True))
    quality = sorted(((rows[d][5] or 0.0, d) for _, d in want), key=lambda x: (-x[0], x[1]))
    assert [h.id for h in best.hits] == [f"d{d}" for _, d in quality[:2]] and best.features[0][15] == pytest.approx(quality[0][0])
    near = s.search("river", "body", S.Options(size=2, rerank_top_n=2, ranker=R.LinearRanker(weights)))
    assert {h.id for h in near.hits} == {f"d{d}" for _, d in want[:2]}


def test_rankers(spark):
    w = [float(i) for i in range(19)]
    r = R.LinearRanker.from_json(R.LinearRanker(w, 0.5).to_json())
    f = [F.lit(1.0)] * 19
    one = spark.range(1)
    assert one.select(r.score(f)).first()[0] == sum(w) + 0.5
    assert one.select(R.Bm25Ranker().score(f)).first()[0] == 1.0 and one.select(R.ModelRanker().score(f)).first()[0] == 1.0
    for bad in ("[]", "{}", '{"weights": [1]}', '{"weights": ["a"]}', "x"):
        with pytest.raises(InvalidArgument):
            R.LinearRanker.from_json(bad)
    trees = R.ObliviousTrees({"trees": [{"splits": [[0, 0.5], [1, 0.5]], "leaves": [1, 2, 3, 4]}], "bias": 10})
    assert trees(np.array([[0.0, 0, 9], [1, 0, 9], [0, 1, 9], [1, 1, 9]])).tolist() == [11, 12, 13, 14]
    assert one.select(R.ModelRanker(trees).score(f)).first()[0] == 14.0


def test_pool_and_training(spark, tmp_path):
    rows = docs(30, 3)
    index = index_of(spark, rows)
    judged = spark.createDataFrame([("river", "d1", 2, 0), ("river", "d2", 0, 0), ("river", "nobody", 1, 0), ("(bad", "d1", 1, 1)], "query string, doc_id string, label int, query_id int")
    got = pools.pool(index, judged, "body")
    assert got.count() == 3 and got.columns == ["label", "query_id", *(f"f{i}" for i in range(19))]
    assert [r for r in got.collect() if r.label == 1][0][2:] == tuple([0.0] * 19)
    pools.write_pool(got, str(tmp_path / "pool"))
    assert len(spark.read.option("sep", "\t").csv(str(tmp_path / "pool")).columns) == 21
    rng = np.random.default_rng(0)
    data = [(float(x[3] > 0), q, list(x)) for q in range(5) for x in rng.normal(size=(20, 19))]
    model = R.train_linear(data)
    assert np.argmax(np.abs(model.weights)) == 3
    # what no line can say: near to a value
    bent = [(2.0 if abs(x[3]) < 0.5 else 0.0, q, list(x)) for q in range(8) for x in rng.normal(size=(30, 19))]
    trees = R.ObliviousTrees(R.train_trees(bent, trees=30, depth=3))
    score = trees(np.array([[0.0] * 3 + [v] + [0.0] * 15 for v in (-2.0, 0.1, 2.0)]))
    assert score[1] > score[0] + 0.5 and score[1] > score[2] + 0.5
    assert R.train_trees([(1.0, 0, [0.0] * 19)])["trees"] == [] and R.train_trees([(1.0, 0, [0.0] * 19), (0.0, 0, [0.0] * 19)])["trees"] == []


def test_pool_without_a_cap(spark, tmp_path, monkeypatch):
    from tidewater import queries

    rows = docs(40, 3)
    index = index_of(spark, rows)
    query = "river OR harbor OR stone OR light"
    matching = {r._id for r in S.candidates(index, Q.parse(query, "body")).join(index.docs, ["seg", "doc"]).collect()}
    judged = spark.createDataFrame([(query, r[0], i, 0) for i, r in enumerate(rows)], "query string, doc_id string, label int, query_id int")
    scored = lambda n: {rows[r.label][0]: tuple(r[2:]) for r in pools.pool(index, judged, "body", n).collect() if any(r[2:])}
    every = scored(None)
    assert len(matching) > 5 and set(every) == matching and every == scored(1000) and len(scored(5)) == 5
    # the query asks for no cap
    caps = []
    monkeypatch.setattr(queries, "pool", lambda index, judged, field, top_n=1000: caps.append(top_n) or pools.pool(index, judged, field, top_n))
    queries.QUERIES["j9_pool"](spark, "/root/testdata/sf0.001")
    assert caps == [None]


def test_metrics(spark):
    hits = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "z", 3), ("b", "x", 1)], "query_id string, id string, rank int")
    judged = spark.createDataFrame([("a", "y", 3), ("a", "q", 1), ("b", "x", 0), ("c", "x", 2)], "query_id string, id string, label int")
    got = {r.query_id: (r.ndcg, r.precision, r.mrr) for r in metrics.quality(hits, judged).collect()}
    assert got["a"] == pytest.approx((7 / math.log2(3) / (7 + 1 / math.log2(3)), 0.2, 0.5)) and got["b"] == got["c"] == (0.0, 0.0, 0.0)
    times = spark.sql("SELECT timestamp_micros(id * 300000) AS ts, id % 4 > 0 AS ok, cast(id AS double) AS ms FROM range(100)")
    counts = metrics.buckets(times, "ts", 1, "ok")
    assert counts.agg(F.sum("n"), F.sum("errors")).first()[:] == (100, 25)
    assert metrics.best_rolling(counts, 10).first().best == 34 and metrics.peak_inside(counts).first().peak == 4
    assert metrics.percentiles(times, "ms").first()[:] == (100, 49.5, 50.0, 95.0, 99.0)


def test_empty_index_and_nulls(spark):
    index = index_of(spark, [("a", None, None, None, None, None, 0), ("b", "", "river", "c", [None, 2.0], None, 1)])
    assert S.Searcher(index).search("river", "body").total_hits == 1
    empty = P.build(spark.createDataFrame([], SCHEMA), Schema.from_mappings(MAPPING), 0, F.col("noise"))
    for text in ("", "river", "nofield:x"):
        assert S.Searcher(empty).search(text, "body").total_hits == 0


def test_sums_in_order(spark):
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=3000).round(2).tolist(), [4.0], [1.0, 1.0, None, 7.5], rng.integers(0, 9, 50).astype(float).tolist()):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        some = sorted(v for v in values if v is not None)
        got = metrics.percentiles(df, "v").first()
        assert (got.n, got.p50, got.p95, got.p99) == (len(some), *(some[min(int(len(some) * p), len(some) - 1)] for p in (0.5, 0.95, 0.99)))
    assert metrics.percentiles(spark.createDataFrame([], "v double"), "v").first().p50 is None
    places = sorted({int(x) for x in rng.integers(-300, 9000, 800)})
    counts = spark.createDataFrame([(x, int(rng.integers(1, 9))) for x in places], "bucket bigint, n bigint")
    held = {r.bucket: r.n for r in counts.collect()}
    for width, chunk in ((60, 4096), (60, 64), (5, 7), (100, 10)):
        assert metrics.best_rolling(counts, width, chunk).first().best == max(sum(held.get(b - k, 0) for k in range(width)) for b in held)
    lines = spark.createDataFrame([(int(x), f"q{int(x) % 7}") for x in rng.permutation(200)], "line bigint, query string")
    order = list(dict.fromkeys(q for _, q in sorted((r.line, r.query) for r in lines.collect())))
    assert {(r.query, r.query_id) for r in metrics.auto_query_ids(lines).collect()} == {(q, i) for i, q in enumerate(order)}
