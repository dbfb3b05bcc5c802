"""Suffix-array dedup: repeated passages by a suffix sort that compares by hashes.

A passage is a run of min_words words, whatever their case and what stands between
them. The suffixes sorted are those at anchors: winnowing picks, of every
min_words - GRAM + 1 successive GRAM-word hashes, the least, so that equal passages
hold the same anchor at the same place. Anchors of one hash are a group; suffixes of
different groups don't share GRAM words, so groups are sorted apart, each in one
task. Within a group, merge sort ranks every suffix of a run in its sibling run by
binary search; two suffixes are compared by their common extension, which is again
found by binary search, over prefix polynomial hashes. The suffixes that share their
first r words are an interval of the sorted group; a passage with o words before its
anchor is repeated if in the interval for min_words - o another suffix has the same o
words before it. The ends of what is found are compared byte by byte with its copy;
a group where that fails is done again without hashes.

Anchors whose whole surroundings are equal are one class, of which only the first goes
to the sort: the text of a thousand exact copies is sorted once. Surroundings count as
equal if the BLAKE2b digests of their bytes, of 128 bits, are: unlike polynomial hashes
these aren't known to collide, whatever the text.

A group of more than HOT classes isn't sorted in one task. Each of its anchors is cut up
into the passages it can lie in, min_words - GRAM + 1 at most; equal passages meet by
their digests, in sums that are taken before the rows are moved.
"""

from __future__ import annotations

import hashlib

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import common as C

MIN_WORDS = 50
#: Bytes of text that are hashed at a time, and bytes of surroundings that are written or sorted at a time (a larger group alone); they bound a worker's memory, not the result.
PIECE, BLOB = 1 << 20, 1 << 21
#: Classes of one anchor that are sorted in one task.
HOT = 1 << 14
U64 = np.uint64
_TOP = U64(0xFFFFFFFFFFFFFFFF)


def gram(min_words: int) -> int:
    return min_words // 2 + 1


def _sliding(values: np.ndarray, width: int, take, fill: np.uint64) -> np.ndarray:
    """take (minimum or maximum) over values[i : i + width]; past the end counts as fill."""
    out, done = values.copy(), 1
    while done < width:
        step = min(done, width - done)
        moved = np.full(len(out), fill, U64)
        moved[: len(out) - step] = out[step:]
        out = take(out, moved)
        done += step
    return out


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one space apart, and where each begins (one more entry at the end)."""
    size = ends - starts
    put = np.concatenate(([0], np.cumsum(size + 1)))
    flat = np.full(int(put[-1]), 32, np.uint8)
    local = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(put[:-1], size) + local] = data[np.repeat(starts, size) + local]
    return flat, put


def digests(flat: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2b of each range of bytes, in two halves."""
    view, blake = memoryview(flat), hashlib.blake2b
    raw = b"".join([blake(view[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), hi.tolist())])
    both = np.frombuffer(raw, np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def anchors_of(data: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """(document, place in words, hash of the anchor, the digest of its surroundings in two halves, words before and from it that are looked at)."""
    k = gram(min_words)
    w = min_words - k + 1
    starts, ends, first = C.words(data, offsets)
    count = np.diff(first)
    n = len(starts)
    if n < min_words:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64, np.int64, np.int32, np.int32))
    h = C.word_hashes(data, starts, ends)
    at = np.arange(n) - np.repeat(first[:-1], count)
    left = np.repeat(count, count) - at  # words from here to the document's end
    prefix, power = C.prefix_hashes(h, C.BASE_A), C.powers(C.BASE_A, n + 1)
    grams = np.full(n, _TOP, U64)
    with np.errstate(over="ignore"):
        grams[: n - k + 1] = C.mix(prefix[k:] - prefix[: n - k + 1] * power[k])
    grams[left < k] = _TOP
    least = _sliding(grams, w, np.minimum, _TOP)
    least[left < min_words] = 0
    backward = _sliding(least[::-1], w, np.maximum, U64(0))[::-1]
    pick = np.flatnonzero((backward == grams) & (left >= k) & (np.repeat(count, count) >= min_words))
    before = np.minimum(at[pick], min_words - k)
    after = np.minimum(left[pick], min_words)
    flat, put = spaced(data, starts, ends)
    around, again = digests(flat, put[pick - before], put[pick + after] - 1)
    with np.errstate(over="ignore"):
        around = around ^ C.mix(U64(1000) * before.astype(U64) + after.astype(U64)).view(np.int64)
    doc = np.repeat(np.arange(len(count)), count)[pick]
    return doc, at[pick].astype(np.int32), grams[pick].view(np.int64), around, again, before.astype(np.int32), after.astype(np.int32)


def _anchors(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.utf8(batch.column(2), lower=True)
            for a, b in C.pieces(offsets, PIECE):
                doc, at, g, c, d, before, after = anchors_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], min_words)
                rows = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), pa.array(d), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at), pa.array(before), pa.array(after)], ["g", "c", "d", "doc_id", "th", "at", "before", "after"])

    return run


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), C.text_key(text).alias("th"), F.col(text).alias("text")).where("text is not null")


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (g, c, d, document, place). The ones after the first of a class are known to be later copies and go out at once; of the group that isn't complete yet only the first of each class are held, HOT at most.

    kind: 0 a later copy of its class's first, copy_of; 1 the first of the only class; 2 the first of one of several classes; 3 that of one of more than HOT. many: whether the class has others.
    """
    names = ["g", "doc_id", "th", "at", "before", "after", "kind", "many", "copy_of"]
    held: pa.Table | None = None  # firsts of the last group, with many
    hot: int | None = None  # the last group, if more than HOT of its firsts have come

    def out(t: pa.Table, kind: np.ndarray, many: np.ndarray, copy_of: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(C.one(t.column(x)) for x in ("g", "doc_id", "th", "at", "before", "after")), pa.array(kind.astype(np.int32)), pa.array(many), copy_of], names)

    def firsts(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Of complete groups, with the groups of one lone suffix left out."""
        if not t.num_rows:
            return
        g, many = t.column("g").to_numpy(), t.column("many").to_numpy(zero_copy_only=False)
        _, inverse, size = np.unique(g, return_inverse=True, return_counts=True)
        kind = np.where((size[inverse] > HOT) | (g == hot if hot is not None else False), 3, np.where(size[inverse] > 1, 2, 1))
        keep = np.flatnonzero((kind > 1) | many)
        if len(keep):
            yield out(t.take(pa.array(keep)), kind[keep], many[keep], pa.nulls(len(keep), t.column("doc_id").type))

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]).append_column("many", pa.array(np.zeros(batch.num_rows, bool)))
        if held is not None and held.num_rows:
            t = pa.concat_tables([held, t])
        t = t.combine_chunks()
        g, c, d = (t.column(x).to_numpy() for x in ("g", "c", "d"))
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])))
        th, at, ids = t.column("th").to_numpy(), t.column("at").to_numpy(), C.one(t.column("doc_id"))
        code = C.codes(ids)
        same = np.concatenate(([False], ~new[1:] & (th[1:] == th[:-1]) & (at[1:] == at[:-1]) & (code[1:] == code[:-1])))  # the same row, delivered again
        first = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
        # a copy of the class's first that an earlier batch began may be delivered again too
        same |= ~new & (th == th[first]) & (at == at[first]) & (code == code[first])
        later = np.flatnonzero(~new & ~same)
        many = t.column("many").to_numpy(zero_copy_only=False).copy()
        many[first[later]] = True
        if len(later):
            yield out(t.take(pa.array(later)), np.zeros(len(later)), np.ones(len(later), bool), ids.take(pa.array(first[later])))
        heads = np.flatnonzero(new)
        t = t.set_column(t.schema.get_field_index("many"), "many", pa.array(many)).take(pa.array(heads))
        last = g[heads] == g[-1]
        yield from firsts(t.filter(pa.array(~last)).combine_chunks())
        held = t.filter(pa.array(last)).combine_chunks()
        if hot is not None and hot != g[-1]:
            hot = None
        if hot is not None or held.num_rows > HOT:
            hot = int(g[-1])
            yield from firsts(held.slice(0, held.num_rows - 1))  # only the last class can still get copies
            held = held.slice(held.num_rows - 1)
    if held is not None:
        yield from firsts(held.combine_chunks())


def _wanted(batches: Iterator[pa.RecordBatch]):
    """For each piece of a batch: the batch, its words one space apart and where they begin, and of each wanted place the row, the word and (g, at, before, after, many, hot)."""
    for batch in batches:
        data, offsets = C.utf8(batch.column(2), lower=True)
        for a, b in C.pieces(offsets, PIECE):
            part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts, ends, first = C.words(part, off)
            flat, put = spaced(part, starts, ends)
            wanted = batch.column(3).slice(a, b - a)
            rows = np.repeat(np.arange(b - a), np.diff(wanted.offsets.to_numpy()))
            wants = wanted.flatten()
            columns = [wants.field(x).to_numpy(zero_copy_only=False) for x in range(6)]
            yield batch, flat, put, rows + a, first[rows] + columns[1], columns


def _surroundings(min_words: int):
    """(g, o, c, d, doc_id, th, at, before, many, words): for each wanted place the words around it, lower case, one space apart; of a hot group instead the passages that the place can lie in, from the o-th word before it on, by their digests."""
    names = ["g", "o", "c", "d", "doc_id", "th", "at", "before", "many", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, put, rows, word, (g, at, before, after, many, hot) in _wanted(batches):
            plain = np.flatnonzero(~hot)
            lo, hi = put[word[plain] - before[plain]], put[word[plain] + after[plain]]
            upto = np.concatenate(([0], np.cumsum(hi - lo)))
            for s, e in C.pieces(upto, BLOB):
                own = plain[s:e]
                take = np.repeat(lo[s:e] - (upto[s:e] - upto[s]), (hi - lo)[s:e]) + np.arange(upto[e] - upto[s])
                blob = pa.Array.from_buffers(pa.binary(), e - s, [None, pa.py_buffer((upto[s : e + 1] - upto[s]).astype(np.int32)), pa.py_buffer(flat[take])])
                near = pa.array(rows[own])
                yield pa.RecordBatch.from_arrays([pa.array(g[own]), pa.nulls(len(own), pa.int32()), *(pa.nulls(len(own), pa.int64()) for _ in range(2)), batch.column(0).take(near), batch.column(1).take(near), pa.array(at[own]), pa.array(before[own]), pa.array(many[own]), blob], names)
            for o in range(min_words - gram(min_words) + 1 if hot.any() else 0):
                fits = np.flatnonzero(hot & (before >= o) & (after >= min_words - o))
                for s in range(0, len(fits), 1 << 14):
                    own = fits[s : s + (1 << 14)]
                    c, d = digests(flat, put[word[own] - o], put[word[own] - o + min_words] - 1)
                    near = pa.array(rows[own])
                    yield pa.RecordBatch.from_arrays([pa.array(g[own]), pa.array(np.full(len(own), o, np.int32)), pa.array(c), pa.array(d), batch.column(0).take(near), batch.column(1).take(near), pa.array(at[own]), pa.array(before[own]), pa.array(many[own]), pa.nulls(len(own), pa.binary())], names)

    return run


class Suffixes:
    """Suffixes [start, end) of an array of word hashes, with prefix hashes."""

    def __init__(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.h, self.start, self.end = hashes, start, end
        self.prefix, self.power = C.prefix_hashes(hashes, C.BASE_A), C.powers(C.BASE_A, len(hashes) + 1)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that suffixes x and y share, by binary search over hashes of prefixes."""
        a, b = self.start[x], self.start[y]
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.end[x] - a, self.end[y] - b)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = C.span_hashes(self.prefix, a, a + mid, self.power) == C.span_hashes(self.prefix, b, b + mid, self.power)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x is before y: by the hash of the first word that differs, the shorter first, equals by number."""
        n = self.common(x, y)
        a, b = self.start[x] + n, self.start[y] + n
        over_x, over_y = a >= self.end[x], b >= self.end[y]
        top = len(self.h) - 1
        hx, hy = self.h[np.minimum(a, top)], self.h[np.minimum(b, top)]
        return np.where(over_x | over_y, np.where(over_x & over_y, x < y, over_x), hx < hy)

    def sort(self, group_at: np.ndarray, group_size: np.ndarray) -> np.ndarray:
        """The order of the suffixes by merge sort, each group of neighbours in itself, all groups at once."""
        n = int(group_size.sum())
        order = np.arange(n)
        begin, size = np.repeat(group_at, group_size), np.repeat(group_size, group_size)
        local = np.arange(n) - begin
        width = 1
        while width < (int(group_size.max()) if n else 0):
            run = local // width
            sibling = run ^ 1
            s = np.minimum(sibling * width, size)
            e = np.minimum(s + width, size)
            lo, hi = np.zeros(n, np.int64), e - s
            live = np.flatnonzero(lo < hi)
            while len(live):
                mid = (lo[live] + hi[live]) // 2
                before = self.less(order[begin[live] + s[live] + mid], order[live])
                lo[live] = np.where(before, mid + 1, lo[live])
                hi[live] = np.where(before, hi[live], mid)
                live = live[lo[live] < hi[live]]
            to = begin + (run // 2) * 2 * width + local % width + lo
            merged = np.empty(n, np.int64)
            merged[to] = order
            order = merged
            width *= 2
        return order


def _ranges(ok_first: np.ndarray, ok_last: np.ndarray, place: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Words covered by passages with ok_first .. ok_last words before the anchor; none where ok_last < 0."""
    return np.where(ok_last >= 0, place - ok_last, 0), np.where(ok_last >= 0, place - ok_first + min_words, 0)


def resolve(words: list[bytes], group: np.ndarray, before: np.ndarray, rank: np.ndarray, min_words: int, hashes=C.word_hashes) -> tuple[np.ndarray, ...]:
    """For each anchor the least and greatest number of words before it of a repeated passage, the same for passages with a copy of lower rank, and that copy (-1 where none).

    words: what stands around the anchors, from before words on; rows of a group are neighbours. rank: the anchors' order in the corpus.
    """
    n, span = len(words), min_words - gram(min_words)
    blob = b"".join(words)
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in words]))).astype(np.int64)
    data = np.frombuffer(blob, np.uint8)
    ws, we, first = C.words(data, offsets)
    start, end = first[:-1] + before, first[1:]
    suffixes = Suffixes(hashes(data, ws, we), start, end)
    at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((at, [n])))
    order = suffixes.sort(at, size)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = suffixes.common(order[:-1], order[1:])
    lcp[at] = 0
    length = (end - start)[order]
    some_first, some_last = np.full(n, span + 1), np.full(n, -1)
    late_first, late_last, copy = np.full(n, span + 1), np.full(n, -1), np.full(n, -1)
    partner_first, partner_last = np.full(n, -1), np.full(n, -1)
    r = rank[order]
    for o in range(span + 1):
        interval = np.cumsum(lcp < min_words - o)
        fits = np.flatnonzero((before[order] >= o) & (length >= min_words - o))
        if len(fits) < 2:
            continue
        s = start[order[fits]]
        with np.errstate(over="ignore"):
            key = C.mix(C.span_hashes(suffixes.prefix, s - o, s, suffixes.power) ^ C.mix(interval[fits].astype(U64)))
        by = np.lexsort((r[fits], key))
        k = key[by]
        cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
        many = np.repeat(np.diff(cut), np.diff(cut)) > 1
        rows, least = order[fits[by]][many], order[fits[by[np.repeat(cut[:-1], np.diff(cut))]]][many]
        second = order[fits[by[np.minimum(np.repeat(cut[:-1], np.diff(cut)) + 1, len(by) - 1)]]][many]
        other = np.where(least == rows, second, least)
        partner_first[rows] = np.where(some_first[rows] > o, other, partner_first[rows])
        partner_last[rows] = other
        some_first[rows], some_last[rows] = np.minimum(some_first[rows], o), o
        late = least != rows
        rows, least = rows[late], least[late]
        late_first[rows], late_last[rows] = np.minimum(late_first[rows], o), o
        copy[rows] = np.where((copy[rows] < 0) | (rank[least] < rank[copy[rows]]), least, copy[rows])
    # the ends, byte by byte
    wrong: set[int] = set()
    for x in np.flatnonzero(some_last >= 0).tolist():
        for o, y in ((int(some_first[x]), int(partner_first[x])), (int(some_last[x]), int(partner_last[x]))):
            a, b = start[x] - o, start[y] - o
            if blob[ws[a] : we[a + min_words - 1]] != blob[ws[b] : we[b + min_words - 1]]:
                wrong.add(int(group[x]))
    for g in wrong:
        _exactly(g, blob, ws, we, group, start, end, before, rank, min_words, some_first, some_last, late_first, late_last, copy)
    return some_first, some_last, late_first, late_last, copy


def _exactly(g, blob, ws, we, group, start, end, before, rank, min_words, some_first, some_last, late_first, late_last, copy) -> None:
    """A group without hashes, for where two texts have one hash."""
    span = min_words - gram(min_words)
    rows = np.flatnonzero(group == g)
    for x in (some_first, late_first):
        x[rows] = span + 1
    for x in (some_last, late_last, copy):
        x[rows] = -1
    for o in range(span + 1):
        found: dict[bytes, list[int]] = {}
        for x in rows.tolist():
            if before[x] >= o and end[x] - start[x] >= min_words - o:
                found.setdefault(blob[ws[start[x] - o] : we[start[x] - o + min_words - 1]], []).append(x)
        for same in found.values():
            if len(same) > 1:
                least = min(same, key=lambda x: rank[x])
                for x in same:
                    some_first[x], some_last[x] = min(some_first[x], o), o
                    if x != least:
                        late_first[x], late_last[x] = min(late_first[x], o), o
                        copy[x] = least if copy[x] < 0 or rank[least] < rank[copy[x]] else copy[x]


def _sorted(min_words: int):
    """Rows come sorted by (g, document, place), which is the order of the corpus within a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in C.whole_groups(batches, ["g"], 1 << 12):
            g, th, at, code = *(table.column(x).to_numpy() for x in ("g", "th", "at")), C.codes(table.column("doc_id"))
            again = np.concatenate(([False], (g[1:] == g[:-1]) & (th[1:] == th[:-1]) & (at[1:] == at[:-1]) & (code[1:] == code[:-1])))
            if again.any():
                table = table.filter(pa.array(~again)).combine_chunks()
            g, th, at, before = (table.column(x).to_numpy() for x in ("g", "th", "at", "before"))
            ids, blobs, all_many = C.one(table.column("doc_id")), table.column("words"), table.column("many").to_numpy(zero_copy_only=False)
            size = pc.binary_length(blobs).to_numpy().astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
            upto = np.concatenate(([0], np.cumsum(size)))[first]
            for x, y in C.pieces(upto, BLOB):  # whole groups
                own = np.arange(first[x], first[y])
                words = blobs.slice(first[x], len(own)).to_pylist()
                sf, sl, lf, ll, copy = resolve(words, g[own], before[own].astype(np.int64), np.arange(len(own)), min_words)
                place, many = at[own].astype(np.int64), all_many[own]
                # an anchor whose class has others is repeated wherever a passage fits, which is all around it
                n_words = np.array([w.count(b" ") for w in words], np.int64) - before[own]
                sf, sl = np.where(many, np.maximum(0, min_words - n_words), sf), np.where(many, before[own], sl)
                lo, hi = _ranges(sf, sl, place, min_words)
                llo, lhi = _ranges(lf, ll, place, min_words)
                keep = np.flatnonzero(sl >= 0)
                of = ids.take(pa.array(own[np.maximum(copy[keep], 0)], mask=copy[keep] < 0))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own[keep])), pa.array(th[own[keep]]), *(pa.array(v[keep].astype(np.int32)) for v in (lo, hi, llo, lhi)), of], ["doc_id", "th", "lo", "hi", "later_lo", "later_hi", "copy_of"])

    return run


def _merge(lo: np.ndarray, hi: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Numbers of the unions that ranges, sorted by (doc, lo), belong to; ranges that touch are one."""
    if not len(lo):
        return np.zeros(0, np.int64)
    far = int(hi.max()) + 1
    reach = np.maximum.accumulate(hi.astype(np.int64) + doc * (far + 1))
    return np.cumsum(np.concatenate(([True], lo[1:] + doc[1:] * (far + 1) > reach[:-1]))) - 1


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in C.whole_groups(batches, ["doc_id", "th"]):
        th, lo, hi, llo, lhi = (table.column(x).to_numpy().astype(np.int64) for x in ("th", "lo", "hi", "later_lo", "later_hi"))
        ids, of = C.one(table.column("doc_id")), C.one(table.column("copy_of"))
        code = C.codes(ids)

        def ordered(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            o = rows[np.lexsort((start[rows], th[rows], code[rows]))]
            new = np.concatenate(([True], (th[o][1:] != th[o][:-1]) | (code[o][1:] != code[o][:-1]))) if len(o) else np.zeros(0, bool)
            return o, np.cumsum(new) - 1

        o, doc = ordered(lo, np.arange(len(lo)))
        union = _merge(lo[o], hi[o], doc)
        at = np.flatnonzero(np.concatenate(([True], union[1:] != union[:-1])))
        start, end = lo[o][at], np.maximum.reduceat(hi[o], at)
        big = len(lo) + 1
        known = np.where(np.asarray(of.is_null()), big, C.order_of(of))
        least = np.minimum.reduceat(known[o], at)
        values, holder = np.unique(known, return_index=True)
        where = np.empty(len(lo), np.int64)
        where[o] = union
        p, pdoc = ordered(llo, np.flatnonzero(lhi > 0))
        cuts = [[] for _ in at]
        if len(p):
            u = _merge(llo[p], lhi[p], pdoc)
            b = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            for span, s, e in zip(where[p][b].tolist(), llo[p][b].tolist(), np.maximum.reduceat(lhi[p], b).tolist()):
                cuts[span].append({"start": s, "end": e})
        rows = pa.array(o[at])
        copies = of.take(pa.array(holder[np.searchsorted(values, least)], mask=least == big))
        yield pa.RecordBatch.from_arrays([ids.take(rows), pa.array(th[o[at]]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(cuts, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), copies], ["doc_id", "text_key", "start_word", "end_word", "cuts", "copy_of"])


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, start_word, end_word, cuts, copy_of): the maximal runs of words that lie in passages of min_words words found at another place too.

    Words are maximal runs of ASCII letters and digits and of characters beyond ASCII, in lower case; they are numbered from 0, and
    end_word isn't included. cuts are the parts that lie in passages with an earlier copy, by (doc_id with null last, hash of the
    text, place); copy_of is a document with such a copy (null if there is none, or if that has a null id). A passage may repeat in its
    own document. Ids may be of any type that can be ordered. Nothing is sampled or capped: the result is that of comparing all passages with all. Rows equal in doc_id and text
    are one document delivered several times. Null and empty texts and those under min_words words have no rows. An empty table gives
    none. Other columns aren't read. min_words is 2 at least.
    """
    scratch = C.Scratch(docs.sparkSession)
    keyed = _keyed(docs, id_col, text)
    kind = keyed.schema["doc_id"].dataType.simpleString()
    found = keyed.mapInArrow(_anchors(min_words), f"g bigint, c bigint, d bigint, doc_id {kind}, th bigint, at int, before int, after int")
    null_last = F.col("doc_id").asc_nulls_last()
    firsts = scratch.cut(found.repartition("g").sortWithinPartitions("g", "c", "d", null_last, "th", "at").mapInArrow(_classify, f"g bigint, doc_id {kind}, th bigint, at int, before int, after int, kind int, many boolean, copy_of {kind}"))
    lo, hi, none = F.col("at") - F.col("before"), F.col("at") + F.col("after"), F.lit(0)
    known = firsts.where("kind < 2").select("doc_id", "th", lo.alias("lo"), hi.alias("hi"), F.when(F.col("kind") == 0, lo).otherwise(none).alias("later_lo"), F.when(F.col("kind") == 0, hi).otherwise(none).alias("later_hi"), "copy_of")

    wants = firsts.where("kind > 1").groupBy(F.col("doc_id").alias("wd"), F.col("th").alias("wt")).agg(F.collect_list(F.struct("g", "at", "before", "after", "many", (F.col("kind") == 3).alias("hot"))).alias("wants"))
    texts = keyed.join(wants, F.col("doc_id").eqNullSafe(F.col("wd")) & (F.col("th") == F.col("wt"))).select("doc_id", "th", "text", "wants")
    near = scratch.cut(texts.mapInArrow(_surroundings(min_words), f"g bigint, o int, c bigint, d bigint, doc_id {kind}, th bigint, at int, before int, many boolean, words binary"))
    around = near.where("o is null").select("g", "doc_id", "th", "at", "before", "many", "words")
    ranges = f"doc_id {kind}, th bigint, lo int, hi int, later_lo int, later_hi int, copy_of {kind}"
    every = known.unionByName(around.repartition("g").sortWithinPartitions("g", null_last, "th", "at").mapInArrow(_sorted(min_words), ranges))
    # of hot groups: equal passages meet by their digests
    passages = near.where("o is not null").select("g", "o", "c", "d", "doc_id", "th", (F.col("at") - F.col("o")).alias("lo"))
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "lo")
    met = passages.groupBy("g", "o", "c", "d").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    own = passages.join(met, ["g", "o", "c", "d"]).withColumn("later", place != F.col("first"))
    later = lambda x: F.when(F.col("later"), x)
    every = every.unionByName(own.select("doc_id", "th", "lo", (F.col("lo") + min_words).alias("hi"), F.coalesce(later(F.col("lo")), none).alias("later_lo"), F.coalesce(later(F.col("lo") + min_words), none).alias("later_hi"), later(F.col("first.doc_id")).alias("copy_of")))
    every = every.unionByName(firsts.where("kind = 3 and many").select("doc_id", "th", lo.alias("lo"), hi.alias("hi"), none.alias("later_lo"), none.alias("later_hi"), F.lit(None).cast(kind).alias("copy_of")))
    return every.repartition("doc_id", "th").sortWithinPartitions("doc_id", "th").mapInArrow(_spans, f"doc_id {kind}, text_key bigint, start_word int, end_word int, cuts array<struct<start:int,end:int>>, copy_of {kind}")


def cut_later(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the words of passages.cuts, from the first byte of a cut's first word to the last of its last; n_chars is kept true.

    Documents without cuts stay as they are, as do null texts; documents of which no word is left go.
    """
    own = {x: C.free_name(docs, f"tw_{x}") for x in ("key", "id", "th", "cuts", "out")}
    cuts = passages.groupBy(F.col("doc_id").alias(own["id"]), F.col("text_key").alias(own["th"])).agg(F.flatten(F.collect_list("cuts")).alias(own["cuts"])).where(F.size(own["cuts"]) > 0)

    @F.arrow_udf("text string, words int")
    def run(column: pa.Array, lists: pa.Array) -> pa.Array:
        out, left = [], []
        for value, drop in zip(column, lists):
            if not drop.is_valid or not value.is_valid:
                out.append(value.as_py())
                left.append(1)
                continue
            raw = value.as_py().encode()
            data, offsets = C.utf8(pa.array([value.as_py()]), lower=True)
            plain = np.frombuffer(raw, np.uint8)
            # lower case may change the bytes of a text, not which of them are words
            starts, ends, _ = C.words(plain, np.array([0, len(plain)]))
            keep, spared = np.ones(len(plain), bool), np.ones(len(starts), bool)
            for x in drop.as_py():
                keep[starts[x["start"]] : ends[x["end"] - 1]] = False
                spared[x["start"] : x["end"]] = False
            out.append(plain[keep].tobytes().decode())
            left.append(int(spared.sum()))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(left, pa.int32())], ["text", "words"])

    keyed = docs.withColumn(own["key"], C.text_key(text))
    joined = keyed.join(cuts, F.col(f"`{id_col}`").eqNullSafe(F.col(own["id"])) & (F.col(own["key"]) == F.col(own["th"])), "left")
    done = joined.withColumn(own["out"], run.asNondeterministic()(F.col(text), F.col(own["cuts"]))).where(F.col(own["out"])["words"] > 0)
    changed = F.col(own["cuts"]).isNotNull()
    done = done.withColumn(text, F.col(own["out"])["text"])
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(changed, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(*(F.col(f"`{c}`") for c in docs.columns))
