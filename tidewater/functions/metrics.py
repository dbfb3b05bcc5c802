"""Measures of ranking quality and of throughput, as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(hits: DataFrame) -> DataFrame:
    """hits (query_id, id, score) with rank from 1, best score first, ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w))


def quality(hits: DataFrame, judgments: DataFrame, k: int = 10, p_at: int = 5) -> DataFrame:
    """(query_id, ndcg, precision, mrr) for every query of judgments (query_id, id, label).

    hits has (query_id, id, rank). Unjudged hits have label 0. NDCG sets the gain 2^label - 1 of the first k against the best order of
    all judged labels (0 if that is 0), precision the relevant among the first p_at against p_at, MRR is one over the first
    relevant rank (0 if there is none). Queries without hits have 0 in all.
    """
    labels = judgments.select("query_id", "id", F.col("label").cast("double").alias("label"))
    seen = hits.join(labels, ["query_id", "id"], "left").select("query_id", "rank", F.coalesce("label", F.lit(0.0)).alias("label"))
    gain = lambda label, rank: (F.pow(F.lit(2.0), label) - 1) / F.log2(rank + 1.0)
    got = seen.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, gain(F.col("label"), F.col("rank")))).alias("dcg"),
        F.sum(F.when((F.col("rank") <= p_at) & (F.col("label") > 0), 1).otherwise(0)).alias("relevant"),
        F.min(F.when(F.col("label") > 0, F.col("rank"))).alias("first"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("label"), "id")
    best = labels.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(gain(F.col("label"), F.col("rank"))).alias("ideal"))
    ndcg = F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(F.lit(0.0))
    return best.join(got, "query_id", "left").select("query_id", ndcg.alias("ndcg"), (F.coalesce("relevant", F.lit(0)) / p_at).alias("precision"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def mean_quality(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.avg("ndcg").alias("ndcg"), F.avg("precision").alias("precision"), F.avg("mrr").alias("mrr"))


#: Ranges into which values are cut for sums in order; windows hold one range each, and one a row for each range.
RANGES = 256


def _ranges(df: DataFrame, value: str) -> Column:
    """The number of the range that a value lies in: of about equal counts, by approximate borders. Any borders give right sums, so it doesn't matter how near they are."""
    at = df.stat.approxQuantile(value, [i / RANGES for i in range(1, RANGES)], 0.25 / RANGES)
    borders = F.array(*(F.lit(float(x)) for x in sorted(set(at)))) if at else F.array().cast("array<double>")
    return F.size(F.filter(borders, lambda x: x <= F.col(value).cast("double")))


def running(df: DataFrame, value: str, weight: str) -> DataFrame:
    """df with upto: the sum of weight over all rows of this value or less. Values are distinct numbers. No window holds more than one range of them."""
    cut = df.withColumn("_range", _ranges(df, value))
    totals = cut.groupBy("_range").agg(F.sum(weight).alias("_all"))
    base = totals.select("_range", (F.sum("_all").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_all")).alias("_base"))  # RANGES rows at most
    inside = F.sum(weight).over(Window.partitionBy("_range").orderBy(value))
    return cut.join(F.broadcast(base), "_range").withColumn("upto", F.col("_base") + inside).drop("_range", "_base")


def percentiles(df: DataFrame, value: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """One row: n, mean, and for each share p the value at place int(n * p) of the sorted values (the last at most). Exact; equal values are counted first, and the distinct ones ordered range by range."""
    values = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    total = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    both = running(values, "v", "c").crossJoin(F.broadcast(total))
    picks = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col("v"))).alias(f"p{round(p * 100)}") for p in at]
    return both.agg(F.max("n").alias("n"), F.max("mean").alias("mean"), *picks)


def buckets(df: DataFrame, ts: str, seconds: int = 1, ok: str | None = None) -> DataFrame:
    """(bucket, n, errors): events by spans of time."""
    # a time without a zone counts as UTC
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{ts}`)") if df.schema[ts].dataType.simpleString() == "timestamp_ntz" else F.unix_micros(ts)
    bad = F.sum(F.when(~F.col(ok), 1).otherwise(0)) if ok else F.lit(0)
    return df.where(F.col(ts).isNotNull()).groupBy(F.floor(micros / (1_000_000 * seconds)).alias("bucket")).agg(F.count("*").alias("n"), bad.cast("bigint").alias("errors"))


def best_rolling(counts: DataFrame, width: int = 60, chunk: int = 4096) -> DataFrame:
    """One row: best, the greatest sum of n over width successive buckets. Buckets without events count 0. Buckets are summed chunk by chunk, the first width - 1 of a chunk together with the end of the one before."""
    step = max(chunk, width)
    own = F.floor(F.col("bucket") / step)
    late = F.col("bucket") - own * step >= step - (width - 1)
    there = counts.select("bucket", "n", own.alias("own"), F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))).alias("part"))
    w = Window.partitionBy("part").orderBy("bucket").rangeBetween(-(width - 1), 0)
    return there.withColumn("s", F.sum("n").over(w)).where("own = part").agg(F.max("s").alias("best"))


def peak_inside(counts: DataFrame) -> DataFrame:
    """One row: peak, the greatest n but for the first and the last bucket, which are cut short."""
    ends = counts.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    return counts.crossJoin(F.broadcast(ends)).where("bucket > lo and bucket < hi").agg(F.max("n").alias("peak"))


def auto_query_ids(lines: DataFrame, line: str = "line", query: str = "query") -> DataFrame:
    """lines with query_id: queries are numbered from 0 by where they appear first. line is a number that is another in each row."""
    first = lines.groupBy(query).agg(F.min(line).alias("first"), F.lit(1).alias("one"))
    numbered = running(first, "first", "one").select(query, (F.col("upto") - 1).cast("int").alias("query_id"))
    return lines.join(numbered, query)
