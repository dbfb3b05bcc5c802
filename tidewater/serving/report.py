"""Reports on engines: ranking quality over judged queries, sustained load, and two engines side by side.

An engine is a function search(query, default field or None, size) that gives identifiers, the best first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import metrics
from tidewater.operators.postings import Index
from tidewater.operators.search import Options, Searcher
from tidewater.serving import load

Engine = Callable[[str, "str | None", int], "list[str]"]


def field_of(query: str) -> str | None:
    """The field of a query that is a single field:term, which then is its default field too."""
    return query.split(":", 1)[0] if ":" in query and " " not in query else None


def engine(index: Index, default_field: str | None = None) -> Engine:
    """An index as an engine. Queries without a field of their own look in default_field."""
    searcher = Searcher(index)
    return lambda query, field, size: [h.id for h in searcher.search(query, field or default_field, Options(size=size)).hits]


def http_engine(url: str, index: str) -> Engine:
    """A running server as an engine."""
    return lambda query, field, size: [h["_id"] for h in load.ask(url, index, field, query, size)["hits"]]


def judged_queries(judgments: DataFrame) -> list[str]:
    return [r.query for r in judgments.select("query").distinct().orderBy("query").collect()]


def quality_report(spark: SparkSession, search: Engine, judgments: DataFrame, size: int = 10) -> dict:
    """{"queries", "ndcg@10", "p@5", "mrr"}: means over the queries of judgments (query, doc_id, label). Queries come to the driver, where the engine is asked."""
    rows = [(q, i, rank) for q in judged_queries(judgments) for rank, i in enumerate(search(q, field_of(q), size), 1)]
    hits = spark.createDataFrame(rows, "query_id string, id string, rank int")
    judged = judgments.select(F.col("query").alias("query_id"), F.col("doc_id").alias("id"), "label")
    means = metrics.quality(hits, judged)
    out = metrics.mean_quality(means).crossJoin(means.agg(F.count("*").alias("queries"))).first()
    return {"queries": out.queries, "ndcg@10": out.ndcg or 0.0, "p@5": out.precision or 0.0, "mrr": out.mrr or 0.0}


def load_report(spark: SparkSession, search: Engine, queries: list[str], clients: int = 16, seconds: float = 60.0, warm_up: float = 2.0, size: int = 10) -> dict:
    """As load.report, of an engine that is called here."""
    asked = [(field_of(q), q) for q in queries]
    return load.report(spark, load.drive(lambda field, text: search(text, field, size), asked, clients, seconds, warm_up))


def compare(spark: SparkSession, first: Engine, second: Engine, judgments: DataFrame, size: int = 10, **load_options) -> dict:
    """Both engines' quality and load, the differences of quality, and which is ahead by NDCG and by answers; on a tie the first."""
    queries = judged_queries(judgments)
    quality = [quality_report(spark, e, judgments, size) for e in (first, second)]
    loads = [load_report(spark, e, queries, size=size, **load_options) for e in (first, second)]
    answered = [x["requests"] - (x["errors"] or 0) for x in loads]
    return {
        "quality": quality, "load": loads, "difference": {k: quality[0][k] - quality[1][k] for k in quality[0]},
        "ahead": {"quality": 0 if quality[0]["ndcg@10"] >= quality[1]["ndcg@10"] else 1, "load": 0 if answered[0] >= answered[1] else 1},
    }
