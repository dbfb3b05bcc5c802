"""Helpers shared by the operators: text as bytes in numpy, word hashes, lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes that belong to words: ASCII letters and digits, and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True
WORD[128:] = True
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Bytes of text that are hashed at a time; a single longer document is taken alone.
CHUNK = 1 << 19
#: Words that are hashed at a time: there are some numbers of 8 bytes for each of their bytes meanwhile.
WORDS = 1 << 17


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. It is the cluster's own setting; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tidewater-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of what came before. What isn't dropped goes when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at, self.live = spark, f"{shared_dir(spark)}/tidewater-{uuid.uuid4().hex}", []
        self.count = 0
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.at}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        self.live.append(path)
        return out

    def drop(self, df: DataFrame | str) -> None:
        """Deletes a table that no later step reads."""
        name = df if isinstance(df, str) else df._scratch
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.live = [x for x in self.live if x != name]

    def clear(self, *kept: DataFrame) -> None:
        """Deletes all tables but these."""
        for name in self.live:
            if name not in [x._scratch for x in kept]:
                self.drop(name)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def text_key(text: str = "text"):
    """64 bits of the text; null and empty differ."""
    return F.when(F.col(text).isNotNull(), F.xxhash64(F.lit(7), F.col(text))).otherwise(F.lit(0)).cast("bigint")


def one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A column as one array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def codes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal where the values are; nulls are equal."""
    return one(column).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def order_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the values, equal where they are; nulls come last."""
    return pc.rank(one(column), "ascending", null_placement="at_end", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], rows: int = 1 << 15) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that come sorted by these columns, each of about so many rows; a group that is larger comes alone."""
    held: list[pa.RecordBatch] = []
    size, enough = 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(size - 1, bool)
        for name in by:
            a, b = table.column(name).slice(0, size - 1), table.column(name).slice(1)
            new |= np.asarray(pc.fill_null(pc.not_equal(a, b), False)) | (np.asarray(pc.is_null(a)) != np.asarray(pc.is_null(b)))
        cut = np.flatnonzero(new)
        if len(cut):
            yield table.slice(0, int(cut[-1]) + 1).combine_chunks()
            held = table.slice(int(cut[-1]) + 1).to_batches()
            size = sum(x.num_rows for x in held)
        enough = max(rows, 2 * size)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def utf8(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about size bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


_POWERS: dict[int, np.ndarray] = {}
#: Powers that are kept of each base, 2 MB of them; longer tables are made for one use.
KEPT_POWERS = 1 << 18


def powers(base: int, n: int) -> np.ndarray:
    """base to the 0 .. n - 1, modulo 2**64."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        kept = np.empty(max(n, KEPT_POWERS), U64)
        kept[0] = 1
        kept[1:] = base
        with np.errstate(over="ignore"):
            np.multiply.accumulate(kept, out=kept)
        if n <= KEPT_POWERS:
            _POWERS[base] = kept
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each document's first word (one more entry at the end)."""
    inside = WORD[data]
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE_A) -> np.ndarray:
    """Polynomial hashes of the words' bytes, spread over 64 bits."""
    if not len(starts):
        return np.zeros(0, U64)
    if len(starts) > WORDS:
        return np.concatenate([word_hashes(data, starts[i : i + WORDS], ends[i : i + WORDS], base) for i in range(0, len(starts), WORDS)])
    length = ends - starts
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    local = np.arange(int(length.sum())) - np.repeat(first, length)
    taken = data[np.repeat(starts, length) + local].astype(U64)
    with np.errstate(over="ignore"):
        taken += U64(1)
        taken *= powers(base, int(length.max()))[local]
        return mix(np.add.reduceat(taken, first) ^ (length.astype(U64) << U64(48)))


def prefix_hashes(hashes: np.ndarray, base: int) -> np.ndarray:
    """p[i] is the polynomial hash of the first i values, by Horner's rule modulo 2**64: p[i+1] = p[i] * base + h[i]."""
    n = len(hashes)
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        scaled = hashes * powers(inverse, n + 1)[1:]
        out = np.zeros(n + 1, U64)
        np.cumsum(scaled, out=out[1:])
        return out * powers(base, n + 1)


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end) from prefix hashes; power[n] is the base to the n."""
    with np.errstate(over="ignore"):
        return prefix[end] - prefix[start] * power[end - start]
