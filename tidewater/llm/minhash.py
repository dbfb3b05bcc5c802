"""MinHash near-duplicates by an inverted join over signature coordinates.

Every document gets a signature of K minima. It is posted under each
(coordinate, value) pair. Two documents are near copies if at least T of their K
coordinates agree. Posting lists of one document are dropped where they arise:
they can't collide. A document left with fewer than T lists can't have a partner
and goes too. Of the others, with the lists in one global order from short to
long, only the first K - T + 1 are merged: two documents that agree T times share
one of these (prefix). While a list is merged, pairs that met in an earlier list are
skipped, which leaves each pair one count; the coordinates of what is left are
compared directly, which gives the exact number of collisions.

Documents of one signature are one class, and only classes are posted and joined. A
list of more than PART members is cut into parts, and each task merges two of them,
so no task holds a list whole. What comes out of a task are for each member the number of
documents it matches, and as few links as join the same members: never its pairs.
Where only the links are asked for (near_dedup), members that are reached are compared
no more, so comparisons in a group of near copies follow its size, not the square of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import common as C

K = 64
THRESHOLD = 0.4375
SHINGLE = 3
#: Members of a list that one task takes from each of two parts; lists up to SMALL are compared pair by pair.
PART, SMALL = 4096, 48
#: Pairs that are compared at a time.
PAIRS = 1 << 16


def signatures_of(data: np.ndarray, offsets: np.ndarray, k: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature (documents, k) of uint32, and whether the document has a word."""
    n = len(offsets) - 1
    out, has = np.zeros((n, k), np.uint32), np.zeros(n, bool)
    seeds = C.mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(C.BASE_B))
    for a, b in C.pieces(offsets):
        off = offsets[a : b + 1] - offsets[a]
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = C.words(part, off)
        h = C.word_hashes(part, starts, ends)
        count = np.diff(first)
        some = np.flatnonzero(count)
        if not len(some):
            continue
        grams = np.zeros(len(h), np.uint64)
        with np.errstate(over="ignore"):
            # a document of fewer words than a shingle is one shingle of those it has
            left = np.repeat(first[1:], count) - np.arange(len(h))
            for j in range(shingle):
                moved = np.zeros(len(h), np.uint64)
                moved[: len(h) - j] = h[j:] if j else h
                grams += np.where(left > j, moved, np.uint64(j + 1)) * np.uint64(pow(C.BASE_A, j + 1, 1 << 64))
            grams = C.mix(grams)
            keep = (left >= shingle) | (np.arange(len(h)) == np.repeat(first[:-1], count))
            grams = grams[keep]
            per = np.maximum(count[some] - shingle + 1, 1)
            at = np.concatenate(([0], np.cumsum(per)[:-1]))
            for i in range(k):
                out[a + some, i] = np.minimum.reduceat((grams ^ seeds[i]) * np.uint64(C.BASE_A), at) >> np.uint64(32)
        has[a + some] = True
    return out, has


def signatures(docs: DataFrame, k: int = K, shingle: int = SHINGLE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, sig binary of k little-endian uint32) of every document with at least one word; th is the hash of the text, the id keeps its type.

    Documents with null or empty text, or without a word, have no shingle, so they are near copies of nothing and don't appear.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, has = signatures_of(*C.utf8(batch.column(2), lower=True), k, shingle)
            rows = np.flatnonzero(has)
            flat = np.ascontiguousarray(sig[rows]).view(np.uint8).reshape(-1)
            offs = (np.arange(len(rows) + 1) * 4 * k).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offs), pa.py_buffer(flat)])
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), blob], ["id", "th", "sig"])

    keyed = docs.select(F.col(id_col).alias("id"), C.text_key(text).alias("th"), F.col(text).alias("text"))
    return keyed.mapInArrow(run, f"id {keyed.schema['id'].dataType.simpleString()}, th bigint, sig binary")


def _postings(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = np.arange(k, dtype=np.int64) << 32
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy()
                sig = _matrix(batch.column(1), k)
                yield pa.RecordBatch.from_arrays([pa.array((sig.astype(np.int64) | tag).reshape(-1)), pa.array(np.repeat(ids, k))], ["key", "id"])

    return run


def _matrix(blobs: pa.Array | pa.ChunkedArray, k: int) -> np.ndarray:
    if isinstance(blobs, pa.ChunkedArray):
        blobs = blobs.combine_chunks()
    offs = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    return np.frombuffer(blobs.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(np.uint32).reshape(len(blobs), k)


def roots(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """label with the components of the links (x, y) joined; a component's label is its least member."""
    while True:
        a, b = label[x], label[y]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


class Merge:
    """Merges the lists of one table of postings: links by component, and counts of matching documents if they are wanted."""

    def __init__(self, ids: np.ndarray, sig: np.ndarray, mask: np.ndarray, bit: np.ndarray, part: np.ndarray, weight: np.ndarray, need: int, counted: bool):
        self.ids, self.sig, self.mask, self.bit, self.part, self.weight, self.need, self.counted = ids, sig, mask, bit, part, weight, need, counted
        self.label, self.links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        self.bits = np.uint64(1) << np.arange(sig.shape[1], dtype=np.uint64)

    def compare(self, x: np.ndarray, y: np.ndarray) -> None:
        """Counts collisions of the pairs, and takes those with enough of them whose first common prefix list is this one."""
        for at in range(0, len(x), PAIRS):
            i, j = x[at : at + PAIRS], y[at : at + PAIRS]
            same = self.sig[i] == self.sig[j]
            ok = np.flatnonzero(same.sum(1) >= self.need)
            i, j, same = i[ok], j[ok], same[ok]
            both = (same * self.bits).sum(1, dtype=np.uint64) & self.mask[i] & self.mask[j]
            own = np.flatnonzero((both & (~both + np.uint64(1))) == np.uint64(1) << self.bit[i])
            i, j = i[own], j[own]
            self.label = roots(self.label, i, j)
            if self.counted:
                np.add.at(self.links, i, self.weight[j])
                np.add.at(self.links, j, self.weight[i])

    def small(self, at: np.ndarray, size: np.ndarray) -> None:
        """All lists of one size at once."""
        for n in np.unique(size).tolist():
            i, j = np.triu_indices(n, 1)
            own = at[size == n]
            for s in range(0, len(own), max(1, PAIRS // len(i))):
                begin = own[s : s + max(1, PAIRS // len(i)), None]
                x, y = (begin + i).reshape(-1), (begin + j).reshape(-1)
                cross = (self.part[x] != self.part[y]) | self.alone[x]
                self.compare(x[cross], y[cross])

    def large(self, rows: np.ndarray) -> None:
        """A list whose pairs are all counted. Pairs that share an earlier prefix list have been there, and are skipped."""
        bit = int(self.bit[rows[0]])
        for s in range(0, len(rows), 128):
            x, y = rows[s : s + 128], rows[s:]
            left = y[None, :] > x[:, None]
            if not self.alone[rows[0]]:
                left &= self.part[y][None, :] != self.part[x][:, None]
            for c in range(bit):
                mx, my = ((self.mask[r] >> np.uint64(c)) & np.uint64(1) > 0 for r in (x, y))
                if mx.any() and my.any():
                    left &= ~((self.sig[x, c][:, None] == self.sig[y, c][None, :]) & mx[:, None] & my[None, :])
                    if left.sum() * 16 < left.size:
                        break
            i, j = np.nonzero(left)
            self.compare(x[i], y[j])

    def reach(self, rows: np.ndarray) -> None:
        """A list of which only the components are wanted: what has been reached isn't compared with what is reached later."""
        alone = bool(self.alone[rows[0]])
        rest = rows
        while len(rest):
            root, rest = rest[0], rest[1:]
            queue = np.array([root])
            while len(queue) and len(rest):
                now, queue = queue[:32], queue[32:]
                count = np.zeros((len(now), len(rest)), np.uint8)
                for c in range(self.sig.shape[1]):
                    count += self.sig[now, c][:, None] == self.sig[rest, c][None, :]
                near = count >= self.need
                if not alone:
                    near &= self.part[now][:, None] != self.part[rest][None, :]
                hit = near.any(0)
                if hit.any():
                    new, rest = rest[hit], rest[~hit]
                    self.label = roots(self.label, np.full(len(new), root), new)
                    queue = np.concatenate((queue, new))

    def run(self, at: np.ndarray, size: np.ndarray, alone: np.ndarray) -> None:
        """at, size: of the lists; alone: for each member whether its list is in one part."""
        self.alone = alone
        few = (size > 1) & (size <= SMALL)
        self.small(at[few], size[few])
        for s, n in zip(at[size > SMALL].tolist(), size[size > SMALL].tolist()):
            (self.large if self.counted else self.reach)(np.arange(s, s + n))


def _merged(k: int, need: int, counted: bool):
    """(id, to, links) of the members that match another: to is the least member of the part of the list that it is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in C.whole_groups(batches, ["key", "a", "b"]):
            key, a, b, ids, part, mask, weight = (table.column(c).to_numpy() for c in ("key", "a", "b", "id", "part", "mask", "n"))
            at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            size = np.diff(np.concatenate((at, [len(key)])))
            merge = Merge(ids, _matrix(table.column("sig"), k), mask.view(np.uint64), (key >> 32).astype(np.uint64), part, weight, need, counted)
            merge.run(at, size, a == b)
            to = np.flatnonzero((merge.label != np.arange(len(ids))) | (merge.links > 0))
            yield pa.RecordBatch.from_arrays([pa.array(ids[to]), pa.array(ids[merge.label[to]]), pa.array(merge.links[to])], ["id", "to", "links"])

    return run


def _classes(docs: DataFrame, scratch: C.Scratch, k: int, shingle: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """((id, th, sig) of the distinct documents, (cls, sig, n) of the distinct signatures with a number of their own and that of their documents)."""
    sigs = scratch.cut(signatures(docs, k, shingle, id_col, text).dropDuplicates(["id", "th"]))
    return sigs, scratch.cut(sigs.groupBy("sig").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("cls"), "sig", "n"))


def _links(heads: DataFrame, k: int, need: int, counted: bool) -> DataFrame:
    """(id, to, links) over the numbers of the classes, some rows a class."""
    keys = heads.select(F.col("cls").alias("id"), "sig").mapInArrow(_postings(k), "key bigint, id bigint")
    shared = keys.join(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key")
    own = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("size", "key"))).alias("lists")).where(F.size("lists") >= need)  # K at most
    prefix = own.select("id", F.slice("lists", 1, F.size("lists") - (need - 1)).alias("lists"))
    masked = prefix.withColumn("mask", F.expr("aggregate(lists, 0L, (m, x) -> m | shiftleft(1L, cast(shiftright(x.key, 32) as int)))"))
    posted = masked.join(heads.select(F.col("cls").alias("id"), "sig", "n"), "id").select("id", "mask", "sig", "n", F.explode("lists").alias("l"))
    parts = F.ceil(F.col("l.size") / PART)
    placed = posted.withColumns({"parts": parts, "part": F.pmod(F.xxhash64("id"), parts)})
    blocks = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    rows = blocks.select(F.col("l.key").alias("key"), F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "id", "part", "mask", "n", "sig")
    return rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "id").mapInArrow(_merged(k, need, counted), "id bigint, to bigint, links bigint")


def _need(k: int, threshold: float) -> int:
    if not 1 <= k <= 64:
        raise ValueError("a signature has 1 to 64 coordinates")
    return max(1, int(np.ceil(threshold * k - 1e-9)))


def near_duplicates(docs: DataFrame, k: int = K, threshold: float = THRESHOLD, shingle: int = SHINGLE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, links) of every document that has a near copy, a row each.

    links is the number of other documents whose signatures agree with this one's in at least threshold * k coordinates; class_id is
    the least id of those linked with it directly or through others. A document is a distinct (id, text): a repeated row
    counts once, and two texts under one id are two documents, which have a row each and may be copies of one another. Documents of
    a null id take part; class_id is null if no other in the class has an id. Texts that are null, empty or without a word are copies
    of nothing, and like all documents without a near copy they have no row. Nothing is capped or sampled: against brute force over
    the same signatures the result is exact. An empty table gives no rows. Ids may be of any type that can be ordered. Other columns
    aren't read, so their names don't matter. k is at most 64, else ValueError.
    """
    need, scratch = _need(k, threshold), C.Scratch(docs.sparkSession)
    sigs, heads = _classes(docs, scratch, k, shingle, id_col, text)
    found = scratch.cut(_links(heads, k, need, True))
    least = components(found.select(F.col("id").alias("doc_a"), F.col("to").alias("doc_b")), scratch)
    counts = found.groupBy("id").agg(F.sum("links").alias("more"))
    per = heads.select("cls", "sig", "n").join(counts.withColumnRenamed("id", "cls"), "cls", "left").join(least.withColumnRenamed("id", "cls"), "cls", "left")
    linked = per.select("sig", F.coalesce("least", "cls").alias("group"), (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("links")).where("links > 0")
    members = scratch.cut(sigs.join(linked, "sig").select("id", "group", "links"))
    scratch.clear(members)
    ids = members.groupBy("group").agg(F.min("id").alias("class_id"))
    return members.join(ids, "group").select(F.col("id").alias("doc_id"), "class_id", "links")


def components(pairs: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(id, least): every id of a pair that isn't its component's least, with that. Large-star and small-star steps until nothing changes, each written to the shared folder."""
    edges = scratch.cut(pairs.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).where("a < b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and m < b").select(F.col("m").alias("a"), "b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b")
        new = scratch.cut(small.select(F.col("m").alias("a"), "b").unionByName(small.where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct())
        # done when it is a star forest: nothing that is pointed at points on
        done = not new.join(new.select(F.col("b").alias("a")), "a", "left_semi").head(1) and new.count() == new.select("b").distinct().count()
        scratch.drop(edges)
        edges = new
        if done:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("least"))


def near_dedup(docs: DataFrame, k: int = K, threshold: float = THRESHOLD, shingle: int = SHINGLE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the near copies: of each class of near_duplicates the least document stays, by (id with null last, hash of the text).

    Texts without a word, null and empty ones too, are copies of nothing and stay. Rows equal in id and text are one document and
    stand or fall together; two texts under one id are two. An empty table stays empty; other columns pass through whatever their names.
    """
    need, scratch = _need(k, threshold), C.Scratch(docs.sparkSession)
    sigs, heads = _classes(docs, scratch, k, shingle, id_col, text)
    least = components(_links(heads, k, need, False).select(F.col("id").alias("doc_a"), F.col("to").alias("doc_b")), scratch)
    per = heads.join(least.withColumnRenamed("id", "cls"), "cls", "left").where("least is not null or n > 1").select("sig", F.coalesce("least", "cls").alias("group"))
    # the least class of a component points at nothing, so it comes in by those that point at it
    tops = heads.join(least.select(F.col("least").alias("cls")).distinct(), "cls").where("n = 1").select("sig", F.col("cls").alias("group"))
    place = F.struct(F.col("id").isNull().alias("z"), "id", "th")
    members = scratch.cut(sigs.join(per.unionByName(tops), "sig").select("group", place.alias("place")))
    scratch.clear(members)
    stays = members.groupBy("group").agg(F.min("place").alias("first"))
    own = {c: C.free_name(docs, f"tw_{c}") for c in ("id", "th", "key")}
    gone = members.join(stays, "group").where("place != first").select(F.col("place.id").alias(own["id"]), F.col("place.th").alias(own["th"]))
    keyed = docs.withColumn(own["key"], C.text_key(text))
    on = F.col(f"`{id_col}`").eqNullSafe(F.col(own["id"])) & (F.col(own["key"]) == F.col(own["th"]))
    return keyed.join(gone, on, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
