"""Line dedup by a suffix array over line identities.

A document is the sequence of its lines that aren't blank; a line's identity is a
128-bit hash (two different lines share one with a chance of 1 in 10**14 among 10**12
distinct ones). Lines that occur once can't be in a repeated run, so the suffixes
sorted are those that begin with a repeated line. Ranks by the first line come from
a prefix sum over the counts of the repeated lines; prefix doubling then refines
them: the rank by d + s lines (s is d, or less to hit min_lines) is the rank by d
lines plus the number of suffixes of that group whose lines from the s-th on rank
lower. A document's end, and a line that occurs once, are symbols of their own, above
all others. Suffixes alone in their group are done and take no part in later rounds.

The suffixes of one rank by d lines are an interval of the array in which the common
prefix of neighbours is at least d: an LCP interval. Those of min_lines lines decide:
the earliest copy in the order (doc_id, text hash, line) stays, and the min_lines lines
that each other suffix of the interval begins with go. A later copy of a maximal
repeated run is the union of such blocks, so this deletes precisely the later copies
of all maximal runs, and rounds beyond min_lines change nothing in it; they run where
the runs' lengths are wanted, until the array is whole and the common prefixes of its
neighbours are known. A line of LONG_WORDS words counts as a run by itself.

No step brings the suffixes of a common line into one task: counts are summed before
they are moved, ranks come from sums over groups of 2**20 ranks and then within each,
and joins on a rank may be split by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import common as C
from tidewater.llm.quality import lines_of

MIN_LINES = 2
LONG_WORDS = 50
KEY = ("doc_id", "th")
#: Prefix sums run over groups of 2**GROUP ranks and within them, so windows stay small up to 2**40 suffixes.
GROUP = 20
#: Above all ranks: where the symbols begin that are alike in no two places.
ALONE = 1 << 62
#: Bytes of text that are cut into lines at a time (a longer text alone).
PIECE = 1 << 19
_BLANK = np.isin(np.arange(256), [*b" \t\r\v\f"])


def _line_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Identities, numbers and words of the lines that aren't blank, and where each document's begin."""
    starts, ends, per = lines_of(data, offsets)
    full = ~_BLANK[data] & (data != 10)
    filled = np.concatenate(([0], np.cumsum(full)))
    begins = full.copy()
    begins[1:] &= ~full[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = full[heads]
    word = np.concatenate(([0], np.cumsum(begins)))
    alive = np.flatnonzero(filled[ends] > filled[starts])
    view = memoryview(np.ascontiguousarray(data))
    ids = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(starts[alive].tolist(), ends[alive].tolist())]), ">i8").astype(np.int64).reshape(-1, 2)
    first = np.concatenate(([0], np.cumsum(per)))
    cuts = np.searchsorted(alive, first).astype(np.int32)
    return ids, (alive - np.repeat(first[:-1], np.diff(cuts))).astype(np.int32), (word[ends] - word[starts])[alive], cuts


def sequences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", long_words: int | None = LONG_WORDS) -> DataFrame:
    """(doc_id, th, hi, lo, at, long): identities, in two halves, and numbers of the lines that aren't blank, and the places among them of those of long_words words; one row for each distinct (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.utf8(batch.column(2))
            for a, b in C.pieces(offsets, PIECE):
                ids, number, words, cuts = _line_ids(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                offs = pa.array(cuts)
                big = np.flatnonzero(words >= long_words) if long_words else np.zeros(0, np.int64)
                begin = np.searchsorted(big, cuts)
                places = pa.array((big - np.repeat(cuts[:-1], np.diff(begin))).astype(np.int32))
                lists = [*(pa.ListArray.from_arrays(offs, pa.array(np.ascontiguousarray(x))) for x in (ids[:, 0], ids[:, 1], number)), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), places)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *lists], ["doc_id", "th", "hi", "lo", "at", "long"])

    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), C.text_key(text).alias("th"), F.col(f"`{text}`").alias("text"))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, th bigint, hi array<bigint>, lo array<bigint>, at array<int>, long array<int>").where("size(at) > 0").dropDuplicates([*KEY])


def first_ranks(lines: DataFrame) -> DataFrame:
    """(doc_id, th, i, rank) of the suffixes that begin with a line that occurs more than once; rank counts the suffixes whose first line is lower."""
    counts = lines.groupBy("hi", "lo").agg(F.count("*").alias("n")).where("n > 1").withColumn("bucket", F.shiftright("hi", 48))
    totals = counts.groupBy("bucket").agg(F.sum("n").alias("all"))
    below = totals.select("bucket", (F.sum("all").over(Window.partitionBy(F.lit(0)).orderBy("bucket")) - F.col("all")).alias("base"))  # 65,536 rows at most
    within = Window.partitionBy("bucket").orderBy("hi", "lo")
    ranked = counts.join(below, "bucket").select("hi", "lo", (F.col("base") + F.sum("n").over(within) - F.col("n")).alias("rank"))
    return lines.join(ranked, ["hi", "lo"]).select(*KEY, "i", "rank")


def refined(state: DataFrame, step: int, whole: bool) -> DataFrame:
    """Ranks by d lines to ranks by d + step lines, step at most d; live: whether another suffix shares these. Unless whole, suffixes that aren't live are left out."""
    rows = state.withColumn("ahead", F.max("rank").over(Window.partitionBy(*KEY).orderBy("i").rangeBetween(step, step))).where("live")
    # a symbol of its own comes after all others
    rows = rows.withColumn("ahead", F.coalesce("ahead", F.lit(ALONE) + F.col("uid"))) if whole else rows.where("ahead is not null")
    counts = rows.groupBy("rank", "ahead").agg(F.count("*").alias("n")).withColumn("g", F.shiftright("ahead", GROUP))
    upper = counts.groupBy("rank", "g").agg(F.sum("n").alias("all"))
    base = upper.select("rank", "g", (F.sum("all").over(Window.partitionBy("rank").orderBy("g")) - F.col("all")).alias("base"))
    within = F.sum("n").over(Window.partitionBy("rank", "g").orderBy("ahead")) - F.col("n")
    table = counts.join(base, ["rank", "g"]).select("rank", "ahead", (F.col("rank") + F.col("base") + within).alias("next"), (F.col("n") > 1).alias("again"))
    met = rows.join(table if whole else table.where("again"), ["rank", "ahead"]).select(*KEY, "i", F.col("next").alias("rank"), F.col("again").alias("live"), "uid")
    return met.unionByName(state.where("not live")) if whole else met


def suffix_array(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text: str = "text", scratch: C.Scratch | None = None, long_words: int | None = LONG_WORDS, whole: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """(sequences, intervals, array, firsts).

    intervals are the suffixes (doc_id, th, i, rank) that share their first min_lines lines with others; rank is the left end of their
    interval. If whole, array has the place of every suffix that begins with a repeated line, and firsts its rank by that line alone.
    """
    scratch = scratch or C.Scratch(docs.sparkSession)
    seqs = scratch.cut(sequences(docs, id_col, text, long_words))
    lines = seqs.select(*KEY, F.posexplode(F.arrays_zip("hi", "lo")).alias("i", "l")).select(*KEY, "i", "l.hi", "l.lo")
    state, depth = scratch.cut(first_ranks(lines).withColumns({"live": F.lit(True), "uid": F.monotonically_increasing_id()})), 1
    firsts, intervals = state, None
    while True:
        if depth == min_lines:
            intervals = state.where("live")
            if not whole:
                return seqs, intervals, None, None
        if not state.where("live").head(1):
            return seqs, state.where("live") if intervals is None else intervals, state, firsts
        step = min(depth, min_lines - depth) if depth < min_lines else depth
        old, state, depth = state, scratch.cut(refined(state, step, whole)), depth + step
        if old is not firsts and depth - step != min_lines:
            scratch.drop(old)


def later_copies(intervals: DataFrame) -> DataFrame:
    """(doc_id, th, i): of each interval all suffixes but the earliest in the corpus."""
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "i")
    first = intervals.groupBy("rank").agg(F.min(place).alias("first"))
    return intervals.join(first, "rank").where(place != F.col("first")).select(*KEY, "i")


def later_long_lines(seqs: DataFrame) -> DataFrame:
    """(doc_id, th, i): the long lines that are also earlier in the corpus. The earliest copy is in no later copy of a run, so it stays."""
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th", "i")
    lines = seqs.select(*KEY, "hi", "lo", F.explode("long").alias("i")).select(*KEY, "i", F.get("hi", "i").alias("hi"), F.get("lo", "i").alias("lo"))
    first = lines.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    return lines.join(first, ["hi", "lo"]).where(place != F.col("first")).select(*KEY, "i")


def longest_common(array: DataFrame, firsts: DataFrame) -> DataFrame:
    """(doc_id, th, i, before_id, before_th, before_i, lcp): for each place of the suffix array the common prefix with the suffix before it, where it has two lines or more.

    Of neighbours that stay neighbours line after line only the last pair is compared line by line, by the ranks of the lines; the others follow.
    """
    a = array.select("rank", F.col("doc_id").alias("da"), F.col("th").alias("ta"), F.col("i").alias("ia"))
    b = array.select((F.col("rank") + 1).alias("rank"), F.col("doc_id").alias("db"), F.col("th").alias("tb"), F.col("i").alias("ib"))
    diagonal = ["da", "ta", "db", "tb", "diff"]
    pairs = a.join(b, "rank").withColumn("diff", F.col("ia") - F.col("ib"))
    runs = pairs.withColumn("run", F.col("ia") - F.row_number().over(Window.partitionBy(*diagonal).orderBy("ia")))
    runs = runs.withColumn("more", F.max("ia").over(Window.partitionBy(*diagonal, "run")) - F.col("ia"))
    ends = runs.where("more = 0").select(*diagonal, "run", "ia", "ib")
    each = firsts.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("i", "rank"))).alias("r")).select("doc_id", "th", F.transform("r", lambda x: x["i"]).alias("at"), F.transform("r", lambda x: x["rank"]).alias("r"))

    @F.arrow_udf("int")
    def common(la: pa.Array, ra: pa.Array, ia: pa.Array, lb: pa.Array, rb: pa.Array, ib: pa.Array) -> pa.Array:
        def views(x):
            offs, values = x.offsets.to_numpy(), x.values.to_numpy()
            return [values[s:e] for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]

        def dense(at, rank, i):
            """Ranks of the lines from i on as far as they all repeat."""
            s = int(np.searchsorted(at, i))
            gap = np.flatnonzero(at[s:] != np.arange(i, i + len(at) - s))
            return rank[s : s + int(gap[0])] if len(gap) else rank[s:]

        out = []
        for p, x, i, q, y, j in zip(views(la), views(ra), ia.to_pylist(), views(lb), views(rb), ib.to_pylist()):
            x, y = dense(p, x, i), dense(q, y, j)
            n = min(len(x), len(y))
            differs = np.flatnonzero(x[:n] != y[:n])
            out.append(int(differs[0]) if len(differs) else n)
        return pa.array(out, pa.int32())

    sa, sb = each.toDF("sda", "sta", "la", "ra"), each.toDF("sdb", "stb", "lb", "rb")
    on = lambda d, t, sd, st: F.col(d).eqNullSafe(F.col(sd)) & (F.col(t) == F.col(st))
    last = ends.join(sa, on("da", "ta", "sda", "sta")).join(sb, on("db", "tb", "sdb", "stb"))
    last = last.select(*(F.col(c).alias(f"_{c}") for c in (*diagonal, "run")), common("la", "ra", "ia", "lb", "rb", "ib").alias("tail"))
    same = F.lit(True)
    for c in (*diagonal, "run"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    full = runs.join(last, same).withColumn("lcp", F.col("more") + F.col("tail"))
    return full.where("lcp > 1").select(F.col("da").alias("doc_id"), F.col("ta").alias("th"), F.col("ia").alias("i"), F.col("db").alias("before_id"), F.col("tb").alias("before_th"), F.col("ib").alias("before_i"), "lcp")


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text: str = "text", with_runs: bool = False, long_words: int | None = LONG_WORDS) -> DataFrame:
    """docs without the later copies of repeated runs of at least min_lines lines, and of single lines of at least long_words words; n_chars, if it is a column, is kept true.

    Words are what stands between blanks; with long_words None single lines stay however long. Lines are told apart by 128 bits of hash; blank ones are passed over and stay. "Later" is by (doc_id with null last, hash of the text, line); ids may be of any type that can be ordered.
    Rows equal in doc_id and text are one document delivered several times: each gets the same result, and they aren't copies of
    one another. A document whose every line that isn't blank is deleted goes; null, empty and blank texts stay as they are. An
    empty table stays empty. Extra columns pass through whatever their names. with_runs adds lines_deleted and longest_run, the
    most lines of a repeated run that begins in the document, be it the first copy or a later one (0 if no run has two lines).
    """
    scratch = C.Scratch(docs.sparkSession)
    seqs, intervals, array, firsts = suffix_array(docs, min_lines, id_col, text, scratch, long_words, with_runs)
    marks = later_copies(intervals).select(*KEY, F.explode(F.sequence("i", F.col("i") + min_lines - 1)).alias("i"))
    if long_words:
        marks = marks.unionByName(later_long_lines(seqs))
    gone = marks.groupBy(*KEY).agg(F.collect_set("i").alias("gone"))
    if with_runs:
        pairs = longest_common(array, firsts)
        both = pairs.select(*KEY, "lcp").unionByName(pairs.select(F.col("before_id").alias("doc_id"), F.col("before_th").alias("th"), "lcp"))
        runs = both.groupBy(*KEY).agg(F.max("lcp").alias("run"))
        gone = gone.join(runs.toDF("rd", "rt", "run"), (F.col("doc_id").eqNullSafe(F.col("rd"))) & (F.col("th") == F.col("rt")), "full").select(F.coalesce("doc_id", "rd").alias("doc_id"), F.coalesce("th", "rt").alias("th"), "gone", "run")
    else:
        gone = gone.withColumn("run", F.lit(0))

    @F.arrow_udf("mask array<boolean>, n int, whole boolean")
    def masked(at: pa.Array, lost: pa.Array) -> pa.Array:
        masks, counts, whole = [], [], []
        for numbers, drop in zip(at, lost):
            numbers = numbers.values.to_numpy()
            drop = drop.values.to_numpy() if drop.is_valid else np.zeros(0, np.int32)
            mask = np.zeros(int(numbers[-1]) + 1 if len(drop) else 0, bool)
            mask[numbers[drop]] = True
            masks.append(mask)
            counts.append(len(drop))
            whole.append(len(drop) == len(numbers))
        offs = pa.array(np.concatenate(([0], np.cumsum([len(m) for m in masks]))).astype(np.int32))
        flat = pa.array(np.concatenate(masks)) if masks else pa.array([], pa.bool_())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offs, flat), pa.array(counts, pa.int32()), pa.array(whole, pa.bool_())], ["mask", "n", "whole"])

    there = seqs.select(F.col("doc_id").alias("sd"), F.col("th").alias("st"), "at").join(gone, F.col("sd").eqNullSafe(F.col("doc_id")) & (F.col("st") == F.col("th")))
    masks = scratch.cut(there.select("doc_id", "th", F.coalesce("run", F.lit(0)).cast("int").alias("run"), masked("at", "gone").alias("m")).select("doc_id", "th", "run", "m.*"))
    scratch.clear(masks)

    own = {c: C.free_name(docs, c) for c in ("tw_key", "tw_mask", "tw_n", "tw_run", "tw_whole", "tw_id", "tw_th")}
    side = masks.select(F.col("doc_id").alias(own["tw_id"]), F.col("th").alias(own["tw_th"]), F.col("mask").alias(own["tw_mask"]), F.col("n").alias(own["tw_n"]), F.col("run").alias(own["tw_run"]), F.col("whole").alias(own["tw_whole"]))
    keyed = docs.withColumn(own["tw_key"], C.text_key(text))
    on = F.col(f"`{id_col}`").eqNullSafe(F.col(own["tw_id"])) & (F.col(own["tw_key"]) == F.col(own["tw_th"]))
    joined = keyed.join(side.hint("shuffle_hash"), on, "left").where(f"{own['tw_whole']} is null or not {own['tw_whole']}")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.concat_ws("\n", F.filter(lines, lambda x, i: ~F.coalesce(F.get(F.col(own["tw_mask"]), i), F.lit(False))))
    new = F.when(F.col(own["tw_n"]) > 0, kept).otherwise(F.col(text))
    out = joined.withColumn(text, new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(own["tw_n"]) > 0, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    extra = [F.coalesce(own["tw_n"], F.lit(0)).alias("lines_deleted"), F.coalesce(own["tw_run"], F.lit(0)).alias("longest_run")] if with_runs else []
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *extra)
