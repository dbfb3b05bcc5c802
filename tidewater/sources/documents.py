"""Readers of documents, mappings, judgments and query lists."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.errors import InvalidArgument
from tidewater.functions import coerce
from tidewater.operators.postings import weight_column
from tidewater.plans.schema import Schema
from tidewater.sources.files import Files


def spread(df: DataFrame) -> DataFrame:
    """A frame straight from a scan, over as many partitions as there are cores at least.

    A small table may lie in one row group, which one task would read and analyze alone. Large inputs have more splits than cores
    and stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def typed(lines: DataFrame, schema: Schema, value: str = "value", extras: bool = True) -> DataFrame:
    """JSON lines to (other columns, _id, the schema's fields[, weights, _quality]).

    Blank lines, lines that aren't a JSON object and documents without a string _id that isn't empty are passed over; fields
    that the schema hasn't are ignored. extras: whether token weights and _quality are read as well.
    """
    keep = [c for c in lines.columns if c != value]
    parsed = lines.where(F.length(F.trim(value)) > 0).select(*keep, F.try_parse_json(value).alias("d"))
    parsed = parsed.where(F.schema_of_variant("d").startswith("OBJECT"))
    d = F.col("d")
    out = [coerce.json_string(d, "_id").alias("_id")]
    for f in schema.fields:
        if f.name == "_id":
            continue
        out.append(coerce.json_text(d, f.name).alias(f.name))
        if extras and f.store_token_weights:
            out.append(coerce.json_weights(d, weight_column(f.name)).alias(weight_column(f.name)))
    if extras and schema.store_doc_quality:
        out.append(coerce.json_number(d, "_quality").alias("_quality"))
    return parsed.select(*keep, *out).where("_id is not null and _id != ''")


def read_jsonl(spark: SparkSession, path: str, schema: Schema, extras: bool = False) -> DataFrame:
    return typed(spark.read.text(path), schema.with_id(), extras=extras)


def read_mapping(path: str, spark: SparkSession | None = None) -> Schema:
    """The schema of a mapping file, which lies wherever Spark reads if a session is given, else with the driver."""
    if spark is not None:
        text = Files(spark).read(path)
    else:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    try:
        return Schema.from_mappings(json.loads(text))
    except json.JSONDecodeError as e:
        raise InvalidArgument(f"{path}: {e}") from e


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """(line, query, doc_id, label, query_id): rows in which query, doc_id or label is missing, and lines that aren't JSON, are passed over; labels lose their fraction."""
    parsed = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.try_parse_json("value").alias("d"))
    d = F.col("d")
    rows = parsed.where(F.schema_of_variant("d").startswith("OBJECT")).select("line", coerce.json_string(d, "query").alias("query"), coerce.json_string(d, "doc_id").alias("doc_id"), F.try_variant_get(d, "$.label", "double").cast("int").alias("label"), F.try_variant_get(d, "$.query_id", "bigint").alias("query_id"))
    return rows.where("query is not null and doc_id is not null and label is not null")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(field, query) of a list with one query a line, field<TAB>query where a field is given; blank lines and those from # on are passed over."""
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#"))
    parts = F.split(line, "\t", 2)
    return rows.select(F.when(F.size(parts) > 1, parts[0]).alias("field"), F.trim(F.element_at(parts, -1)).alias("query"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON corpus whose identifier is _id or id, as _id; without either InvalidArgument is raised."""
    df = spark.read.json(path)
    if "_id" in df.columns and "id" in df.columns:
        return df.withColumn("_id", F.coalesce("_id", F.col("id").cast("string"))).drop("id")
    if "id" in df.columns:
        return df.withColumnRenamed("id", "_id")
    if "_id" not in df.columns:
        raise InvalidArgument("documents need _id or id")
    return df


def judgment_maps(judgments: DataFrame) -> DataFrame:
    """(query, labels): a map from document to label for each query; of several judgments of one pair the last line counts."""
    last = judgments.groupBy("query", "doc_id").agg(F.max_by("label", "line").alias("label"))
    return last.groupBy("query").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("doc_id", "label")))).alias("labels"))
