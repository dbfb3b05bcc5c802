"""The inverted index as DataFrames, built from documents in one scan.

POSTINGS(seg, doc, field, term, tf, first_pos, weight_q8) is the fact table,
DOCS(seg, doc, _id, stored, quality) the dimension; statistics are aggregates of both.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import analysis, scoring
from tidewater.plans.schema import FieldMapping, Schema

POSTINGS = "seg int, doc bigint, field string, term string, tf int, first_pos int, weight_q8 smallint"
DOCS = "seg int, doc bigint, _id string, stored string, quality float"
#: Numbers of rows that bear the same one, up to which they are broadcast.
BROADCAST_ROWS = 100_000
FIELD_STATS = "seg int, field string, doc_count bigint, sum_field_length bigint, term_count bigint"


def weight_column(name: str) -> str:
    return f"{name}_weights"


def stored_json(df: DataFrame, schema: Schema) -> Column:
    """The stored fields as JSON, names in order, without nulls."""
    names = sorted({"_id", *(f.name for f in schema.fields if f.stored)} & set(df.columns))
    return F.to_json(F.struct(*(F.col(f"`{n}`").cast("string").alias(n) for n in names)))


def document_rows(df: DataFrame, schema: Schema, seg: int | Column = 0, doc: Column | None = None) -> DataFrame:
    """DOCS of a frame with the columns _id, the schema's fields, and _quality where qualities are stored. doc: the document's number, unique in the segment; without one Spark gives numbers, which are only stable once written."""
    quality = F.col("_quality").cast("float") if schema.store_doc_quality and "_quality" in df.columns else F.lit(None).cast("float")
    if schema.store_doc_quality:
        quality = F.coalesce(quality, F.lit(0.0).cast("float"))
    number = doc if doc is not None else F.monotonically_increasing_id()
    return df.select((seg if isinstance(seg, Column) else F.lit(seg)).cast("int").alias("seg"), number.cast("bigint").alias("doc"), F.col("_id").cast("string").alias("_id"), stored_json(df, schema).alias("stored"), quality.alias("quality"))


def _item(name: str, term: Column, tf: Column, pos: Column, weight: Column) -> Column:
    return F.struct(F.lit(name).alias("field"), term.alias("term"), tf.cast("int").alias("tf"), F.least(pos, F.lit(scoring.MAX_POSITION)).cast("int").alias("first_pos"), weight.cast("float").alias("weight"))


def _counted(df: DataFrame, schema: Schema, seg: int | Column, doc: Column | None) -> DataFrame:
    """(seg, doc, field, term, tf, first_pos, weight) of each row by itself. All fields come from one scan; fields that df hasn't and null values have none."""
    first, counts, items = [], [], []

    def add(i: int, f: FieldMapping) -> None:
        tokens, given, found = F.col(f"tokens{i}"), F.col(f"weights{i}"), F.col(f"counts{i}")
        weighed = f.store_token_weights and weight_column(f.name) in df.columns
        one = F.lit(1.0 if f.store_token_weights else None).cast("float")
        if not weighed and analysis.find(f.analyzed_by) is analysis.ANALYZERS["standard"]:
            first.append(F.col(f"`{f.name}`").cast("string").alias(f"text{i}"))
            counts.append(analysis.standard_items(F.col(f"text{i}"), f.name, 1.0 if f.store_token_weights else None, scoring.MAX_POSITION).alias(f"counts{i}"))
            items.append(found)
            return
        first.append(analysis.tokens(F.col(f"`{f.name}`").cast("string"), f.analyzed_by).alias(f"tokens{i}"))
        if weighed:
            first.append(F.col(f"`{weight_column(f.name)}`").cast("array<float>").alias(f"weights{i}"))
        elif f.analyzed_by == "keyword":  # a token at most
            items.append(F.transform(tokens, lambda t: _item(f.name, t, F.lit(1), F.lit(0), one)))
            return
        counts.append(analysis.token_counts(tokens, F.transform(tokens, lambda _, k: F.coalesce(F.get(given, k), one)) if weighed else None).alias(f"counts{i}"))
        items.append(F.transform(found, lambda x: _item(f.name, F.get(tokens, x["pos"]), x["tf"], x["pos"], x["weight"] if weighed else one)))

    for i, f in enumerate(schema.fields):
        if f.name in df.columns:
            add(i, f)
    number = doc if doc is not None else F.monotonically_increasing_id()
    rows = df.select((seg if isinstance(seg, Column) else F.lit(seg)).cast("int").alias("seg"), number.cast("bigint").alias("doc"), *first).select("*", *counts)
    every = F.concat(*(F.coalesce(x, F.array().cast(analysis.ITEMS)) for x in items))
    return rows.select("seg", "doc", F.explode(every).alias("x")).select("seg", "doc", "x.*")


def repeated(df: DataFrame, seg: int | Column, doc: Column) -> DataFrame | None:
    """(seg, doc) of the numbers that several rows bear; None if there are none. This is looked up at once, and reads the columns of the numbers only."""
    keys = df.select((seg if isinstance(seg, Column) else F.lit(seg)).cast("int").alias("seg"), doc.cast("bigint").alias("doc")).groupBy("seg", "doc").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    n = keys.count()
    return (F.broadcast(keys) if n <= BROADCAST_ROWS else keys) if n else None


def postings(df: DataFrame, schema: Schema, seg: int | Column = 0, doc: Column | None = None, shared: DataFrame | None = None) -> DataFrame:
    """POSTINGS: tf counts, the first place among the field's tokens (65,535 at most), the greatest token weight as a byte (null where the field stores none).

    A row's tokens are counted within the row, nothing is moved. Only rows whose number is among `shared`, as repeated() has them, are merged.
    """
    if shared is None:
        rows = _counted(df, schema, seg, doc)
    else:
        keys = shared.select(F.col("seg").alias("__seg"), F.col("doc").alias("__doc"))
        same = (seg if isinstance(seg, Column) else F.lit(seg)).cast("int").eqNullSafe(F.col("__seg")) & doc.cast("bigint").eqNullSafe(F.col("__doc"))
        merged = _counted(df.join(keys, same, "left_semi"), schema, seg, doc).groupBy("seg", "doc", "field", "term").agg(F.sum("tf").cast("int").alias("tf"), F.min("first_pos").alias("first_pos"), F.max("weight").alias("weight"))
        rows = _counted(df.join(keys, same, "left_anti"), schema, seg, doc).unionByName(merged)
    weight = F.when(F.col("weight").isNull(), F.lit(None)).otherwise(scoring.quantize_weight(F.greatest("weight", F.lit(0.0)))).cast("smallint")
    return rows.withColumn("weight", weight).withColumnRenamed("weight", "weight_q8")


def term_stats(p: DataFrame) -> DataFrame:
    """(seg, field, term, df, total_tf)."""
    return p.groupBy("seg", "field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))


def field_stats(p: DataFrame, lengths: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """FIELD_STATS. doc_count counts documents with a token in the field. lengths: the same without terms, terms: a row or more for each term, where they are known from the documents."""
    if lengths is None:
        lengths = _lengths(p)
    terms = (p if terms is None else terms).select("seg", "field", "term").distinct().groupBy("seg", "field").agg(F.count("*").alias("term_count"))
    return lengths.join(terms, ["seg", "field"])


def _lengths(p: DataFrame) -> DataFrame:
    each = p.groupBy("seg", "field", "doc").agg(F.sum("tf").alias("n"))
    return each.groupBy("seg", "field").agg(F.count("*").alias("doc_count"), F.sum("n").alias("sum_field_length"))


def document_lengths(df: DataFrame, schema: Schema, seg: int | Column = 0) -> DataFrame:
    """(seg, field, doc_count, sum_field_length) from the documents themselves: tokens are counted where they are, none is moved."""
    sizes = [F.struct(F.lit(f.name).alias("field"), F.size(analysis.tokens(F.col(f"`{f.name}`").cast("string"), f.analyzed_by)).alias("n")) for f in schema.fields if f.name in df.columns]
    rows = df.select((seg if isinstance(seg, Column) else F.lit(seg)).cast("int").alias("seg"), F.inline(F.array(*sizes))).where("n > 0")
    return rows.groupBy("seg", "field").agg(F.count("*").alias("doc_count"), F.sum("n").cast("bigint").alias("sum_field_length"))


def document_terms(df: DataFrame, schema: Schema, seg: int | Column = 0) -> DataFrame:
    """(seg, field, term, df, total_tf) from the documents themselves, in parts that summed up are term_stats of their postings. Each row counts as a document."""
    texts = {f.name: (F.col(f"`{f.name}`").cast("string"), f.analyzed_by) for f in schema.fields if f.name in df.columns}
    return analysis.term_table(df, seg if isinstance(seg, Column) else F.lit(seg), texts)


def average_lengths(stats: DataFrame) -> DataFrame:
    """(field, avg_field_length) over all segments."""
    return stats.groupBy("field").agg((F.sum("sum_field_length") / F.sum("doc_count")).alias("avg_field_length"))


@dataclass
class Index:
    """A snapshot: frames that don't change. fields: FIELD_STATS, from the postings unless it is given; sizes: the same without terms, which needs no postings; terms: what sums up to term_stats, likewise."""

    schema: Schema
    postings: DataFrame
    docs: DataFrame
    fields: DataFrame | None = None
    sizes: DataFrame | None = None
    terms: DataFrame | None = None
    generation: int = 0
    extra: dict = field(default_factory=dict)

    def field_stats(self) -> DataFrame:
        return self.fields if self.fields is not None else field_stats(self.postings, self.lengths(), self.terms)

    def lengths(self) -> DataFrame:
        """(seg, field, doc_count, sum_field_length) by the shortest way there is."""
        known = self.fields if self.fields is not None else self.sizes
        if known is not None:
            return known.select("seg", "field", "doc_count", "sum_field_length")
        return _lengths(self.postings)

    def term_stats(self) -> DataFrame:
        """(seg, field, term, df, total_tf) by the shortest way there is."""
        if self.terms is None:
            return term_stats(self.postings)
        return self.terms.groupBy("seg", "field", "term").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"))

    def doc_count(self) -> int:
        return self.docs.count()

    def union(self, other: Index) -> Index:
        """Both indexes' segments searched as one."""
        stats = None if self.fields is None or other.fields is None else self.fields.unionByName(other.fields)
        sizes = None if self.sizes is None or other.sizes is None else self.sizes.unionByName(other.sizes)
        terms = None if self.terms is None or other.terms is None else self.terms.unionByName(other.terms)
        return replace(self, postings=self.postings.unionByName(other.postings), docs=self.docs.unionByName(other.docs), fields=stats, sizes=sizes, terms=terms)


def build(df: DataFrame, schema: Schema, seg: int | Column = 0, doc: Column | None = None) -> Index:
    """An index in memory: nothing is computed before it is searched, except which numbers several rows bear. Such rows are one document in the postings."""
    schema = schema.with_id()
    shared = None if doc is None else repeated(df, seg, doc)
    own = {} if shared is not None else {"sizes": document_lengths(df, schema, seg), "terms": document_terms(df, schema, seg)}
    return Index(schema, postings(df, schema, seg, doc, shared), document_rows(df, schema, seg, doc), **own)


def intersect(lists: list[DataFrame], on: list[str] | None = None) -> DataFrame:
    """(seg, doc, freq) of documents in all posting lists; freq sums their tf. One aggregation, not a chain of joins."""
    return _merge(lists, on or ["seg", "doc"]).where(F.col("lists") == len(lists)).drop("lists")


def unite(lists: list[DataFrame], on: list[str] | None = None) -> DataFrame:
    """(seg, doc, freq) of documents in any of the posting lists."""
    return _merge(lists, on or ["seg", "doc"]).drop("lists")


def _merge(lists: list[DataFrame], on: list[str]) -> DataFrame:
    every = None
    for i, x in enumerate(lists):
        part = x.select(*on, F.col("tf").alias("tf"), F.lit(i).alias("i"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(*on).agg(F.sum("tf").alias("freq"), F.count_distinct("i").alias("lists"))


def advance(postings_: DataFrame, target: int) -> DataFrame:
    """The first posting of each segment whose document isn't before target."""
    return postings_.where(F.col("doc") >= target).groupBy("seg").agg(F.min("doc").alias("doc"))
