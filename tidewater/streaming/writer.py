"""The near-real-time writer: a landing folder as the log, a micro-batch as the refresh.

Documents that are added go to a file in the landing folder and are safe from then on.
Refresh runs a streaming query over it: each batch becomes a segment, named by its
number, and shows once the manifest lists it. A batch that runs again after a crash
finds its number in the manifest and does nothing.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.errors import FailedPrecondition, InvalidArgument
from tidewater.operators.postings import Index
from tidewater.plans.schema import Schema
from tidewater.sources import documents, store
from tidewater.sources.files import Files


class IndexWriter:
    """One writer an index: callers see to that. Snapshots taken from it never change."""

    def __init__(self, spark: SparkSession, root: str, schema: Schema | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark)
        self.schema = store.load_schema(self.files, self.root, schema)
        self.files.make(f"{self.root}/landing")
        self.lock = threading.Lock()
        self.manifest = store.load_manifest(self.files, self.root)
        store.validate(spark, self.root, self.manifest, self.schema)
        self.closed = False
        self._number = max([int(n.split(".")[0]) for n in self._landed()] + [int(self.files.read(f"{self.root}/landing.next")) if self.files.exists(f"{self.root}/landing.next") else 0])

    @property
    def generation(self) -> int:
        return self.manifest.generation

    def add_document(self, doc: dict, raw: str | None = None) -> None:
        self.add_documents([doc], [raw] if raw else None)

    def add_documents(self, docs: list[dict], raw: list[str] | None = None) -> None:
        """Nothing is logged unless every document has a string _id that isn't empty, and every raw, if given, is the JSON of an object; it is logged on one line, whatever lines it came in."""
        for d in docs:
            if not isinstance(d.get("_id"), str) or not d["_id"]:
                raise InvalidArgument("a document needs a string _id")
        self._log("".join(line + "\n" for line in (map(self._one_line, raw) if raw else (json.dumps(d, ensure_ascii=False) for d in docs))))

    @staticmethod
    def _one_line(raw: str) -> str:
        try:
            doc = json.loads(raw)
        except ValueError as e:
            raise InvalidArgument(f"not JSON: {e}") from e
        if not isinstance(doc, dict):
            raise InvalidArgument("a document is an object")
        return raw.replace("\n", " ").replace("\r", " ")  # in JSON these stand between values only

    def _open(self) -> None:
        if self.closed:
            raise FailedPrecondition("the writer is closed")

    def land(self, lines: DataFrame) -> None:
        """Logs a frame of JSON lines in the column value, written by the executors; the files are renamed into the log one after another."""
        self._open()
        part = f"{self.root}/incoming-{uuid.uuid4().hex}"
        lines.select("value").write.text(part)
        with self.lock:
            for n in self.files.names(part):
                self.files.rename(f"{part}/{n}", f"{self.root}/landing/{self._next():020d}.jsonl")
        self.files.delete(part)

    def _landed(self) -> list[str]:
        return [n for n in self.files.names(f"{self.root}/landing") if n.endswith(".jsonl")]

    def _next(self) -> int:
        """The number of the next file of the log. There is one writer, so it is looked up once."""
        self._number += 1
        return self._number

    def _log(self, text: str) -> None:
        self._open()
        with self.lock:
            self.files.write(f"{self.root}/landing/{self._next():020d}.jsonl", text)

    def refresh(self) -> int:
        """Makes what was added so far visible and returns the generation, which stays if there was nothing. At that the log is emptied."""
        self._open()
        with self.lock:
            names = self._landed()
            if not names:
                return self.generation
            self.files.write(f"{self.root}/landing.next", str(int(names[-1].split(".")[0])))
            source = self.spark.readStream.schema("value string").format("text").load(f"{self.root}/landing/*.jsonl").withColumn("file", F.input_file_name())
            query = source.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
            for n in names:
                self.files.delete(f"{self.root}/landing/{n}")
            return self.generation

    def _batch(self, df: DataFrame, number: int) -> None:
        if number in self.manifest.batches:
            return
        m = self.manifest
        name = store.stem(m.generation + 1, m.next_seg)
        ordered = documents.typed(df.withColumn("order", F.struct("file", F.monotonically_increasing_id().alias("n"))).drop("file"), self.schema)
        count = store.seal(ordered, self.schema, self.root, m.next_seg, name)
        segments = [*m.segments, {"seg": m.next_seg, "stem": name, "doc_count": count, "fingerprint": self.schema.fingerprint()}] if count else m.segments
        if not count:
            self.files.delete(f"{self.root}/segments/{name}")
        # the last batch is all that a restart may repeat
        new = store.Manifest(m.generation + (1 if count else 0), segments, [number], m.next_seg + 1)
        store.save_manifest(self.files, self.root, new)
        self.manifest = new

    def reader(self) -> Index:
        return store.open_index(self.spark, self.root, self.manifest)

    def close(self) -> None:
        """Doesn't refresh: what is pending stays in the log and is there after the next open. A closed writer takes no documents and doesn't refresh; its snapshots stay readable."""
        self.closed = True


def index_frame(df: DataFrame, schema: Schema, root: str) -> Index:
    """Indexes a whole frame as the next segment, in the order of its rows' _id; for corpora that don't pass through the log."""
    files = Files(df.sparkSession)
    schema = store.load_schema(files, root, schema)
    m = store.load_manifest(files, root)
    name = store.stem(m.generation + 1, m.next_seg)
    count = store.seal(df.withColumn("order", F.col("_id")), schema, root, m.next_seg, name)
    new = store.Manifest(m.generation + 1, [*m.segments, {"seg": m.next_seg, "stem": name, "doc_count": count, "fingerprint": schema.fingerprint()}], m.batches, m.next_seg + 1)
    store.save_manifest(files, root, new)
    return store.open_index(df.sparkSession, root, new)
