"""The 19 features of a (query, document) pair, as columns over the matched leaves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions import scoring

NAMES = (
    "bm25_total", "tf_sum", "idf_sum", "num_matched_terms", "num_query_terms", "match_ratio", "doc_length_avg", "doc_length_min", "bm25_field0", "bm25_field1", "bm25_field2", "bm25_field3",
    "position_decay_sum", "token_weight_sum", "token_weight_max", "doc_quality", "min_idf_matched", "max_idf_matched", "first_pos_min_norm",
)
COUNT = len(NAMES)
VERSION = 2


@dataclass
class Leaf:
    """One analyzed query term; tf is null where the document hasn't got it."""

    field_id: int | None
    boost: float
    decay: float
    weights: bool
    idf: Column
    tf: Column
    first_pos: Column
    weight_q8: Column
    average: Column


def columns(leaves: list[Leaf], quality: Column, k1: float = scoring.K1) -> list[Column]:
    """The features in order, as float. Doubles are summed leaf by leaf, in the query's order, then cast; what isn't set is 0."""

    def total(value) -> Column:
        out = F.lit(0.0)
        for x in leaves:
            out = out + F.when(x.tf.isNotNull(), value(x)).otherwise(F.lit(0.0))
        return out

    def extreme(pick, value) -> Column:
        found = [F.when(x.tf.isNotNull(), value(x)) for x in leaves]
        return F.coalesce(pick(*found) if len(found) > 1 else found[0], F.lit(0.0)) if found else F.lit(0.0)

    bm25 = lambda x: scoring.term_score(x.idf, x.tf, k1) * F.lit(x.boost)
    weight = lambda x: scoring.dequantize_weight(x.weight_q8).cast("double") if x.weights else F.lit(1.0)
    matched = total(lambda x: F.lit(1.0)).cast("float")
    terms = F.lit(float(len(leaves))).cast("float")
    gated = [x for x in leaves if x.decay > 0]

    def decayed(x: Leaf) -> Column:
        return F.coalesce(scoring.position_decay(F.lit(x.decay), x.first_pos, x.average), F.lit(0.0)) if x.decay > 0 else F.lit(0.0)

    norm = [F.when(x.tf.isNotNull() & (x.average > 0), x.first_pos / x.average) for x in gated]
    first = F.coalesce(F.least(*norm) if len(norm) > 1 else norm[0], F.lit(0.0)) if norm else F.lit(0.0)
    by_field = [total(lambda x, i=i: bm25(x) if x.field_id == i else F.lit(0.0)) for i in range(4)]
    out = [
        total(bm25), total(lambda x: x.tf.cast("double")), total(lambda x: x.idf), matched, terms, (matched / terms) if leaves else F.lit(0.0), F.lit(0.0), F.lit(0.0), *by_field,
        total(decayed), total(weight), F.greatest(extreme(F.greatest, weight), F.lit(0.0)), F.coalesce(quality.cast("double"), F.lit(0.0)), extreme(F.least, lambda x: x.idf), extreme(F.greatest, lambda x: x.idf), first,
    ]
    return [c.cast("float") for c in out]


def aggregates(bm25: Column) -> list[Column]:
    """The same by aggregation, for rows (times, idf, tf, first_pos, weight_q8, field_id, boost, decay, weighs, average) of matched leaves grouped by document."""
    times = F.col("times").cast("double")
    boosted = times * bm25 * F.col("boost")
    weight = F.when(F.col("weighs"), scoring.dequantize_weight(F.coalesce("weight_q8", F.lit(32))).cast("double")).otherwise(1.0)
    decayed = scoring.position_decay(F.col("decay"), F.col("first_pos"), F.col("average"))
    gated = F.when((F.col("decay") > 0) & (F.col("average") > 0), F.col("first_pos") / F.col("average"))
    return [
        F.sum(boosted).alias("x0"), F.sum(times * F.col("tf")).alias("x1"), F.sum(times * F.col("idf")).alias("x2"), F.sum(times).alias("x3"), *(F.sum(F.when(F.col("field_id") == i, boosted)).alias(f"x{8 + i}") for i in range(4)),
        F.sum(times * decayed).alias("x12"), F.sum(times * weight).alias("x13"), F.max(weight).alias("x14"), F.min("idf").alias("x16"), F.max("idf").alias("x17"), F.min(gated).alias("x18"),
    ]


def assembled() -> Column:
    """The features from aggregates() and the columns terms (leaves of the query) and quality."""
    ratio = F.col("x3").cast("float") / F.col("terms").cast("float")
    own = {4: F.col("terms"), 5: ratio, 6: F.lit(0.0), 7: F.lit(0.0), 15: F.col("quality")}
    return F.array(*(F.coalesce((own[i] if i in own else F.col(f"x{i}")).cast("float"), F.lit(0.0).cast("float")) for i in range(COUNT)))
