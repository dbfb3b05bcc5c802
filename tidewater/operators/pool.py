"""The training pool of a ranker: features of judged documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.errors import InvalidArgument
from tidewater.functions.features import COUNT
from tidewater.operators import search
from tidewater.operators.postings import Index
from tidewater.plans import query as Q


def pool(index: Index, judgments: DataFrame, default_field: str | None = None, top_n: int | None = 1000) -> DataFrame:
    """(label, query_id, f0 .. f18), a row for each judgment (query, doc_id, label, query_id); documents not among their query's best top_n have zeros; with top_n None those that don't match.

    The different queries come to the driver, where they are parsed, and are searched in one plan; those that can't be read are left
    out with their judgments. Of several documents under one identifier the best counts.
    """
    field = default_field or index.schema.default_field()
    readable = []
    for r in judgments.select("query").where("query is not null").distinct().collect():
        try:
            Q.parse(r.query, field)
            readable.append((r.query, r.query))
        except InvalidArgument:
            pass
    found = search.search_many(index, readable, field, top_n, collect_features=True).join(index.docs.select("seg", "doc", "_id"), ["seg", "doc"])
    best = Window.partitionBy("query_id", "_id").orderBy(F.desc("score"), "seg", "doc")  # as by rank, which no cap leaves unneeded
    found = found.withColumn("n", F.row_number().over(best)).where("n = 1").select(F.col("query_id").alias("query"), F.col("_id").alias("doc_id"), "features")
    known = judgments.sparkSession.createDataFrame([r[:1] for r in readable], "query string")
    columns = [F.coalesce(F.get("features", F.lit(i)), F.lit(0.0).cast("float")).alias(f"f{i}") for i in range(COUNT)]
    return judgments.join(known, "query", "left_semi").join(found, ["query", "doc_id"], "left").select("label", "query_id", *columns)


def write_pool(rows: DataFrame, path: str) -> None:
    """Tab-separated, without a header."""
    rows.write.mode("overwrite").option("sep", "\t").csv(path)


def column_description() -> str:
    return "0\tLabel\n1\tGroupId\n"
