"""An index on disk: schema.json, manifest.json, and one Parquet directory for each segment.

Only the segments that the manifest lists exist; it is replaced in one step.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.errors import Corruption, FailedPrecondition
from tidewater.operators import postings as P
from tidewater.plans.schema import Schema
from tidewater.sources.files import Files

VERSION = 2


@dataclass
class Manifest:
    generation: int = 0
    segments: list[dict] = field(default_factory=list)
    batches: list[int] = field(default_factory=list)
    next_seg: int = 0


def load_manifest(files: Files, root: str) -> Manifest:
    """Without a manifest the index is empty, at generation 0."""
    path = f"{root}/manifest.json"
    if not files.exists(path):
        return Manifest()
    try:
        raw = json.loads(files.read(path))
        if raw["version"] != VERSION:
            raise Corruption(f"manifest: version {raw['version']}")
        return Manifest(int(raw["generation"]), [{"seg": int(s["seg"]), "stem": str(s["stem"]), "doc_count": int(s["doc_count"])} | ({"fingerprint": str(s["fingerprint"])} if "fingerprint" in s else {}) for s in raw["segments"]], [int(b) for b in raw["batches"]], int(raw["next_seg"]))
    except (ValueError, KeyError, TypeError) as e:
        raise Corruption(f"manifest: {e}") from e


def save_manifest(files: Files, root: str, m: Manifest) -> None:
    files.write(f"{root}/manifest.json", json.dumps({"version": VERSION, "generation": m.generation, "segments": m.segments, "batches": m.batches, "next_seg": m.next_seg}, indent=2))


def load_schema(files: Files, root: str, given: Schema | None = None) -> Schema:
    """The stored schema wins over the given one; without either the index can't be opened."""
    path = f"{root}/schema.json"
    if files.exists(path):
        return Schema.from_json(files.read(path))
    if given is None:
        raise FailedPrecondition("the index has no schema and none was given")
    schema = given.with_id()
    files.make(root)
    files.write(path, schema.to_json())
    return schema


def stem(generation: int, seg: int) -> str:
    return f"seg-{generation:020d}-{seg:010d}"


def seal(docs: DataFrame, schema: Schema, root: str, seg: int, name: str, partitions: int | None = None) -> int:
    """Writes a segment of documents in the order of the column `order` and returns how many there are. Postings are sorted by term and field, so that a scan for a term reads few row groups."""
    at = f"{root}/segments/{name}"
    spark = docs.sparkSession
    numbered = docs.orderBy("order").drop("order").withColumn("doc", F.monotonically_increasing_id())
    numbered.write.mode("overwrite").parquet(f"{at}/raw")
    back = spark.read.parquet(f"{at}/raw")
    P.document_rows(back, schema, seg, F.col("doc")).write.mode("overwrite").parquet(f"{at}/docs")
    rows = P.postings(back, schema, seg, F.col("doc")).drop("seg")
    places = ("term", "field", "doc")  # terms differ in their first bytes, which sorting compares first; by documents as well, so that a common term is no task of its own
    spread = rows.repartitionByRange(partitions, *places) if partitions else rows.repartitionByRange(*places)
    spread.sortWithinPartitions(*places).select(F.lit(seg).cast("int").alias("seg"), "*").write.mode("overwrite").parquet(f"{at}/postings")
    P.field_stats(spark.read.parquet(f"{at}/postings"), P.document_lengths(back, schema, seg)).write.mode("overwrite").parquet(f"{at}/fields")
    Files(spark).delete(f"{at}/raw")
    return spark.read.parquet(f"{at}/docs").count()


def validate(spark: SparkSession, root: str, m: Manifest, schema: Schema) -> None:
    """Raises Corruption where a segment isn't there, holds another number of documents than the manifest says, or was analyzed otherwise than this schema's fields are now."""
    for s in m.segments:
        if s.get("fingerprint", schema.fingerprint()) != schema.fingerprint():
            raise Corruption(f"segment {s['stem']} was analyzed by {s['fingerprint']}, not by {schema.fingerprint()}")
    files = Files(spark)
    for s in m.segments:
        for part in ("docs", "postings", "fields"):
            if not files.exists(f"{root}/segments/{s['stem']}/{part}/_SUCCESS"):
                raise Corruption(f"segment {s['stem']} has no {part}")
    if m.segments:
        rows = spark.read.schema(P.DOCS).parquet(*[f"{root}/segments/{s['stem']}/docs" for s in m.segments]).groupBy("seg").count().collect()
        held = {r["seg"]: r["count"] for r in rows}
        for s in m.segments:
            if held.get(s["seg"], 0) != s["doc_count"]:
                raise Corruption(f"segment {s['stem']} holds {held.get(s['seg'], 0)} documents, the manifest says {s['doc_count']}")


def open_index(spark: SparkSession, root: str, manifest: Manifest | None = None) -> P.Index:
    """A snapshot of the segments that the manifest lists now, which are validated; later refreshes don't change it. A manifest that is given isn't validated again."""
    files = Files(spark)
    m = manifest or load_manifest(files, root)
    schema = load_schema(files, root)
    if manifest is None:
        validate(spark, root, m, schema)
    read = lambda part, kind: spark.read.schema(kind).parquet(*[f"{root}/segments/{s['stem']}/{part}" for s in m.segments]) if m.segments else spark.createDataFrame([], kind)
    return P.Index(schema, read("postings", P.POSTINGS), read("docs", P.DOCS), read("fields", P.FIELD_STATS), generation=m.generation, extra={"segments": [s["stem"] for s in m.segments], "fingerprint": schema.fingerprint()})
