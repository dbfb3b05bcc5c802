"""Search: a query becomes one plan over the postings.

The postings of the query's leaves are filtered in the scan, one aggregation by
document turns each leaf into a column, the syntax tree becomes a filter over these
columns, and the score is a fixed sum of leaf scores. Statistics are a frame of a
single row, joined by broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidewater.errors import InvalidArgument
from tidewater.functions import features, scoring
from tidewater.operators.postings import Index
from tidewater.operators.rankers import Ranker
from tidewater.plans import query as Q

MAX_LEAVES = 63
#: Rows up to which a side that the caller sized is broadcast; beyond, the join is left to the optimizer.
BROADCAST_ROWS = 10_000
#: Different terms of a batch that are looked for by a filter; more by a join.
FILTERED_TERMS = 2000


@dataclass
class Options:
    size: int = 10
    rerank_top_n: int = 1000
    ranker: Ranker | None = None
    collect_features: bool = False
    k1: float = scoring.K1
    b: float = scoring.B


def matches(node: Q.Query, index: Index, column: dict[tuple[str, str], Column]) -> Column:
    """The tree as a condition. A term without tokens or of an unknown field matches nothing."""
    if isinstance(node, Q.MatchAll):
        return F.lit(True)
    if isinstance(node, Q.Term):
        tokens = Q.term_tokens(node, index.schema)
        if not tokens or not index.schema.has(node.field):
            return F.lit(False)
        parts = [column[node.field, t].isNotNull() for t in tokens]
        join = lambda a, b: a & b
    else:
        parts = [matches(c, index, column) for c in node.children]
        join = (lambda a, b: a & b) if isinstance(node, Q.And) else (lambda a, b: a | b)
    out = parts[0]
    for p in parts[1:]:
        out = join(out, p)
    return out


def _any_of(pairs: list[tuple[str, str]]) -> Column:
    """A condition that the scan can use: terms by field."""
    by: dict[str, list[str]] = {}
    for f, t in pairs:
        by.setdefault(f, []).append(t)
    out = F.lit(False)
    for f, terms in by.items():
        out = out | ((F.col("field") == f) & F.col("term").isin(terms))
    return out


def candidates(index: Index, node: Q.Query, features_too: bool = False, k1: float = scoring.K1) -> DataFrame:
    """(seg, doc, score[, features]) of all matching documents."""
    if isinstance(node, Q.MatchAll):
        out = index.docs.select("seg", "doc", F.lit(0.0).alias("score"), *(["quality"] if features_too else []))
        return out.withColumn("features", F.array(*features.columns([], F.col("quality"), k1))).drop("quality") if features_too else out
    every = Q.leaves(node, index.schema)
    known = [x for x in dict.fromkeys(every) if index.schema.has(x[0])]
    if not known:
        out = index.docs.select("seg", "doc", F.lit(0.0).alias("score")).where(F.lit(False))
        return out.withColumn("features", F.array(*(F.lit(0.0).cast("float") for _ in range(features.COUNT)))) if features_too else out
    own = index.postings.where(_any_of(known))
    is_leaf = {x: (F.col("field") == x[0]) & (F.col("term") == x[1]) for x in known}
    aggs = []
    for i, x in enumerate(known):
        aggs.append(F.max(F.when(is_leaf[x], F.col("tf"))).alias(f"tf{i}"))
        if features_too:
            aggs += [F.max(F.when(is_leaf[x], F.col(c))).alias(f"{c}{i}") for c in ("first_pos", "weight_q8")]
    found = own.groupBy("seg", "doc").agg(*aggs)
    column = {x: F.col(f"tf{i}") for i, x in enumerate(known)}
    # over the same aggregation as the candidates, whose exchange then serves both
    df = found.agg(*(F.count(f"tf{i}").alias(f"df{i}") for i in range(len(known))))
    found = found.where(matches(node, index, column))
    stats = df.crossJoin(index.docs.agg(F.count("*").alias("n_docs")))
    if features_too:
        fields = sorted({x[0] for x in known})
        avg = index.lengths().where(F.col("field").isin(fields)).agg(*(F.coalesce(F.sum(F.when(F.col("field") == f, F.col("sum_field_length"))) / F.sum(F.when(F.col("field") == f, F.col("doc_count"))), F.lit(0.0)).alias(f"avg_{j}") for j, f in enumerate(fields)))
        stats = stats.crossJoin(avg)
    rows = found.crossJoin(F.broadcast(stats))  # a frame of one row, whatever the index
    idf = {x: scoring.bm25_idf(F.col("n_docs"), F.col(f"df{i}")) for i, x in enumerate(known)}
    score = F.lit(0.0)
    for x in every:
        if x in column:
            score = score + F.coalesce(scoring.term_score(idf[x], column[x], k1), F.lit(0.0))
    if not features_too:
        return rows.select("seg", "doc", score.alias("score"))
    rows = rows.join(index.docs.select("seg", "doc", "quality"), ["seg", "doc"], "left")
    made = []
    for x in every:
        mapping = index.schema.get(x[0])
        if x in column:
            i = known.index(x)
            made.append(features.Leaf(index.schema.id_of(x[0]), mapping.boost, mapping.position_decay, mapping.store_token_weights, idf[x], column[x], F.col(f"first_pos{i}"), F.coalesce(F.col(f"weight_q8{i}"), F.lit(32)), F.col(f"avg_{fields.index(x[0])}")))
        else:
            none = F.lit(None).cast("double")
            made.append(features.Leaf(None, 1.0, 0.0, False, none, F.lit(None).cast("int"), none, none, none))
    return rows.select("seg", "doc", score.alias("score"), F.array(*features.columns(made, F.col("quality"), k1)).alias("features"))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _top(df: DataFrame, n: int) -> DataFrame:
    """Ties go to the earlier document."""
    return df.orderBy(F.desc("score"), "seg", "doc").limit(n)


def best(index: Index, node: Q.Query, options: Options | None = None, counted: Observation | None = None) -> DataFrame:
    """(seg, doc, score[, features]) of the best documents. counted sees the number of all that match, as total, when the frame is run.

    With a ranker the best rerank_top_n (size at least) by BM25 get its score instead, and the best size of these are returned.
    """
    o = options or Options()
    two = o.ranker is not None or o.collect_features
    every = candidates(index, node, two, o.k1)
    if counted is not None:
        every = every.observe(counted, F.count(F.lit(1)).alias("total"))
    pool = _top(every, max(o.rerank_top_n, o.size) if two else o.size)
    if o.ranker is not None:
        columns = [F.col("features")[i] for i in range(features.COUNT)]
        pool = pool.withColumn("score", o.ranker.score(columns).cast("double"))
    if two:
        pool = _top(pool, o.size)
    return pool


def hits(index: Index, node: Q.Query, options: Options | None = None) -> DataFrame:
    """(seg, doc, score[, features], _id, stored) of the best documents; not in order, sort by score descending, seg, doc."""
    o = options or Options()
    return _sized(best(index, node, o), o.size).join(index.docs.select("seg", "doc", "_id", "stored"), ["seg", "doc"])


def total_hits(index: Index, node: Q.Query) -> DataFrame:
    """One row: total."""
    return candidates(index, node).agg(F.count("*").alias("total"))


@dataclass
class Hit:
    score: float
    id: str
    stored_json: str


@dataclass
class SearchResult:
    total_hits: int
    hits: list[Hit]
    features: list[list[float]]


class Searcher:
    """Searches a snapshot and brings the few best documents to the driver."""

    def __init__(self, index: Index):
        self.index = index

    def search(self, query: str | Q.Query, default_field: str | None = None, options: Options | None = None, **kw) -> SearchResult:
        o = options or Options(**kw)
        if o.size < 0:
            raise InvalidArgument("size must not be negative")
        node = Q.parse(query, default_field or self.index.schema.default_field()) if isinstance(query, str) else query
        if not o.size:
            return SearchResult(total_hits(self.index, node).first().total, [], [])
        if not isinstance(node, Q.MatchAll) and not any(self.index.schema.has(f) for f, _ in Q.leaves(node, self.index.schema)):
            return SearchResult(0, [], [])
        counted = Observation()
        rows = sorted(best(self.index, node, o, counted).collect(), key=lambda r: (-r.score, r.seg, r.doc))
        total = counted.get["total"] if rows else 0  # one run for both
        if not rows:
            return SearchResult(0, [], [])
        # segments hold documents in the order of their numbers, so that these few reach few row groups
        where = F.lit(False)
        for seg in {r.seg for r in rows}:
            where = where | ((F.col("seg") == seg) & F.col("doc").isin([r.doc for r in rows if r.seg == seg]))
        stored = {(r.seg, r.doc): r for r in self.index.docs.where(where).select("seg", "doc", "_id", "stored").collect()}
        found = [(r.score, stored[r.seg, r.doc]) for r in rows]
        return SearchResult(total, [Hit(score, d._id, d.stored) for score, d in found], [list(r.features) for r in rows] if o.collect_features else [])


def _batch(index: Index, queries: list[tuple], field: str) -> tuple[list, list, list, list]:
    """Rows of leaves (query_id, bit, field, term, times), of masks (query_id, masks, terms), of queries that match all (query_id,), and the queries (query_id, tree) that masks of leaves can't say."""
    leaf_rows, mask_rows, all_rows, alone = [], [], [], []
    for qid, text in queries:
        node = Q.parse(text, field)
        if isinstance(node, Q.MatchAll):
            all_rows.append((str(qid),))
            continue
        every = Q.leaves(node, index.schema)
        bit = {x: i for i, x in enumerate(dict.fromkeys(every))}
        masks = Q.dnf(node, index.schema, bit) if len(bit) <= MAX_LEAVES else None
        if masks is None:
            alone.append((str(qid), node))
            continue
        if masks:
            mask_rows.append((str(qid), masks, len(every)))
            leaf_rows += [(str(qid), bit[x], x[0], x[1], every.count(x)) for x in bit if index.schema.has(x[0])]
    return leaf_rows, mask_rows, all_rows, alone


def search_many(index: Index, queries: list[tuple], default_field: str | None = None, top: int | None = 10, k1: float = scoring.K1, collect_features: bool = False) -> DataFrame:
    """(query_id, rank, seg, doc, score[, features]) of the best documents of each (query_id, text), in one plan for all; with top None of all that match.

    Leaves of all queries are joined to the postings once; a query is the masks of leaves of which one must be there whole. Query
    ids are strings and must be different. Queries that can't be read raise InvalidArgument. A query of more than 63 different leaves,
    or of very many alternatives, gets a branch of its own in the plan, as if it were searched alone.
    """
    spark = index.docs.sparkSession
    leaf_rows, mask_rows, all_rows, alone = _batch(index, queries, default_field or index.schema.default_field())
    leaves = spark.createDataFrame(leaf_rows, "query_id string, bit int, field string, term string, times int")
    masks = spark.createDataFrame(mask_rows, "query_id string, masks array<bigint>, terms int")
    pairs = sorted({r[2:4] for r in leaf_rows})
    if len(pairs) <= FILTERED_TERMS:  # a filter reaches the scan, and goes below the counting of an index that isn't stored
        own = index.postings.where(_any_of(pairs))
    else:
        own = index.postings.join(_sized(leaves.select("field", "term").distinct(), len(leaf_rows)), ["field", "term"])
    n_docs = index.docs.agg(F.count("*").alias("n_docs"))
    idf = own.groupBy("field", "term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_docs)).select("field", "term", scoring.bm25_idf(F.col("n_docs"), F.col("df")).alias("idf"))
    known = leaves.join(idf, ["field", "term"])
    if collect_features:
        facts = [(f.name, i, float(f.boost), float(f.position_decay), f.store_token_weights) for i, f in enumerate(index.schema.fields)]
        fields = spark.createDataFrame(facts, "field string, field_id int, boost double, decay double, weighs boolean")
        average = index.lengths().groupBy("field").agg((F.sum("sum_field_length") / F.sum("doc_count")).alias("average"))
        known = known.join(fields, "field").join(average, "field", "left")
    rows = own.join(_sized(known, len(leaf_rows)), ["field", "term"])
    bm25 = scoring.term_score(F.col("idf"), F.col("tf"), k1)
    part = F.struct(F.col("bit"), (F.col("times") * bm25).alias("s"))
    sums = features.aggregates(bm25) if collect_features else []
    found = rows.groupBy("query_id", "seg", "doc").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.array_sort(F.collect_list(part)).alias("parts"), *sums)
    found = found.join(_sized(masks, len(mask_rows)), "query_id").where(F.exists("masks", lambda m: F.col("bits").bitwiseAND(m) == m))
    score = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["s"]).alias("score")
    if collect_features:
        found = found.join(index.docs.select("seg", "doc", "quality"), ["seg", "doc"], "left")
    scored = found.select("query_id", "seg", "doc", score, *([features.assembled().alias("features")] if collect_features else []))
    if all_rows:
        extra = [F.array(*features.columns([], F.col("quality"), k1)).alias("features")] if collect_features else []
        scored = scored.unionByName(spark.createDataFrame(all_rows, "query_id string").crossJoin(index.docs.select("seg", "doc", F.lit(0.0).alias("score"), *extra)))
    for qid, node in alone:
        one = candidates(index, node, collect_features, k1).withColumn("query_id", F.lit(qid))
        scored = scored.unionByName(one.select(*scored.columns))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "seg", "doc")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("query_id", "rank", "seg", "doc", "score", *(["features"] if collect_features else []))
