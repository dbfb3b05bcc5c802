"""Text analysis: the standard and the keyword analyzer, as columns and in plain Python.

The columns are built-in expressions, so that they stay in generated code, except those that count tokens,
which go over Arrow batches; the plain versions analyze query strings on the driver and must agree with them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "is", "it", "not", "of", "on", "or", "the", "to", "with")
TOKEN = "[A-Za-z0-9]+"
_STOP = frozenset(STOP_WORDS)


def standard_tokens(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits, lower case, without stop words. Null stays null."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def keyword_tokens(text: Column) -> Column:
    """The whole value as it is; an empty one has no token. Null stays null."""
    return F.when(text.isNull(), F.lit(None)).when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Analyzer:
    """column: from a text column to an array of tokens, null to null; plain: the same for a string on the driver, for queries. Two of one fingerprint give the same tokens."""

    column: Callable[[Column], Column]
    plain: Callable[[str], list[str]]
    fingerprint: str


ANALYZERS: dict[str, Analyzer] = {
    "standard": Analyzer(standard_tokens, lambda text: [t for t in (x.lower() for x in re.findall(TOKEN, text)) if t not in _STOP], "standard:v1"),
    "keyword": Analyzer(keyword_tokens, lambda text: [text] if text else [], "keyword:v1"),
}


def register(name: str, analyzer: Analyzer) -> None:
    """Makes an analyzer known to mappings under a name."""
    if name in ("standard", "keyword") or not name:
        raise ValueError(f"the analyzer {name!r} can't be replaced")
    ANALYZERS[name] = analyzer


def find(name: str) -> Analyzer:
    """An unknown name is the standard analyzer's."""
    return ANALYZERS.get(name, ANALYZERS["standard"])


def tokens(text: Column, name: str) -> Column:
    return find(name).column(text)


def analyze(text: str, name: str = "standard") -> list[str]:
    """The tokens of a string, on the driver."""
    return find(name).plain(text)


def _sums(column: pa.Array) -> pa.Array:
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(size)))
    before = np.concatenate(([0], upto))[first[:-1]]
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(upto - np.repeat(before, size)), mask=column.is_null())


def running_sums(numbers: Column) -> Column:
    """For each array of numbers the sums up to each of them; null stays null."""
    return F.arrow_udf(_sums, "array<bigint>")(numbers)


def token_table(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key..., position, token, start, end): every token that isn't a stop word. position counts stop words too; start and end are byte offsets.

    The offsets are running sums over what lies between the tokens. No token moves to another task for it: the lengths of a row's
    pieces, and nothing else, are summed in Arrow batches.
    """
    whole = F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))
    between = F.slice(F.split(F.col(text), TOKEN, -1), F.lit(1), F.size(whole))
    sizes = F.zip_with(whole, between, lambda t, g: F.octet_length(t) + F.octet_length(g))
    parts = df.select(*key, whole.alias("tokens"), running_sums(sizes).alias("ends"))
    each = parts.select(*key, F.posexplode(F.arrays_zip("tokens", "ends")).alias("position", "x"))
    token = F.lower("x.tokens")
    return each.where(~token.isin(*STOP_WORDS)).select(*key, "position", token.alias("token"), (F.col("x.ends") - F.octet_length("x.tokens")).alias("start"), F.col("x.ends").alias("end"))


#: Tokens that are counted at once, unless one row holds more.
COUNTED_AT_ONCE = 1 << 20
_COUNTS = "array<struct<pos:int,tf:int,weight:float>>"


def _tally(tokens: pa.Array, weights: pa.Array | None) -> pa.Array:
    size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    words = tokens.flatten().dictionary_encode()
    code = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    key = row * (len(words.dictionary) + 1) + code
    order = np.flatnonzero(code >= 0)
    order = order[np.argsort(key[order], kind="stable")]
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    at, tf = order[first], np.diff(np.append(first, len(order)))
    most = pa.nulls(len(first), pa.float32())
    if weights is not None and len(first):
        most = pa.array(np.maximum.reduceat(weights.flatten().to_numpy(zero_copy_only=False)[order], first))
    of = row[at]
    ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(size)))))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array((at - begin[of]).astype(np.int32)), pa.array(tf.astype(np.int32)), most], names=["pos", "tf", "weight"]))


def _in_parts(tokens: pa.Array, weights: pa.Array | None) -> pa.Array:
    upto = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    parts, a = [], 0
    while a < len(upto) or not parts:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + COUNTED_AT_ONCE, side="right")))
        parts.append(_tally(tokens.slice(a, b - a), None if weights is None else weights.slice(a, b - a)))
        a = b
    return pa.concat_arrays(parts)


#: Bytes of text that are analyzed at once, unless one row holds more.
ANALYZED_AT_ONCE = 1 << 22
ITEMS = "array<struct<field:string,term:string,tf:int,first_pos:int,weight:float>>"
_LOWER = np.zeros(256, np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _LOWER[[_c, ord(chr(_c).upper())]] = _c


_LOWER_TABLE = _LOWER.tobytes()


def _standard_codes(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different words, each token's word, each token's row) of the bytes of some rows, which end at these places. Bytes of other characters than letters and digits of ASCII, at least one each, are between tokens. Some words may have no token: stop words."""
    low = np.frombuffer(data.tobytes().translate(_LOWER_TABLE), np.uint8)
    inside = low != 0
    before, after = np.zeros(len(low) + 1, bool), np.zeros(len(low) + 1, bool)
    before[1:], after[:-1] = inside, inside
    before[ends], after[ends] = False, False  # no token goes on in the next row
    before, after = before[:-1], after[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(low[inside])).dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kept = ~pc.is_in(words.dictionary, value_set=pa.array(STOP_WORDS)).to_numpy(zero_copy_only=False).astype(bool)[code]
    return words.dictionary, code[kept], np.searchsorted(ends, start[kept], side="right")


def _tally_text(data: np.ndarray, ends: np.ndarray, field: str, weight: float | None, most: int) -> pa.Array:
    words, code, row = _standard_codes(data, ends)
    size = np.bincount(row, minlength=len(ends))
    key = row * len(words) + code
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    at, tf = order[first], np.diff(np.append(first, len(order)))
    of = row[at]
    place = np.minimum(at - (np.cumsum(size) - size)[of], most)
    n = len(first)
    columns = [pa.repeat(pa.scalar(field), n), words.take(pa.array(code[at])), pa.array(tf.astype(np.int32)), pa.array(place.astype(np.int32)), pa.repeat(pa.scalar(weight, pa.float32()), n)]
    upto = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(ends)))))
    return pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.StructArray.from_arrays(columns, names=["field", "term", "tf", "first_pos", "weight"]))


def _byte_parts(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, the places where its rows end) of each part of some texts, one part at least. Null is an empty text."""
    text = pc.fill_null(text, "")
    size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, offsets, data = text.buffers()
    base = int(np.frombuffer(offsets, kind)[text.offset]) if len(text) else 0
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(ends) or not a:
        done = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + ANALYZED_AT_ONCE, side="right")))
        upto = int(ends[min(b, len(ends)) - 1]) if len(ends) else 0
        yield a, data[base + done : base + upto], ends[a:b] - done
        a = b


def _text_in_parts(text: pa.Array, field: str, weight: float | None, most: int) -> pa.Array:
    return pa.concat_arrays([_tally_text(data, ends, field, weight, most) for _, data, ends in _byte_parts(text)])


def standard_items(text: Column, field: str, weight: float | None, most: int) -> Column:
    """For each text its different tokens by the standard analyzer as (field, term, tf, first_pos, weight): how often each is there, and its first place, `most` at the greatest. Null has none.

    standard_tokens and token_counts in one, over the bytes of many rows at once; the three must agree.
    """

    def items(text: pa.Array) -> pa.Array:
        return _text_in_parts(text, field, weight, most)

    return F.arrow_udf(items, ITEMS)(text)


def _counts(tokens: pa.Array) -> pa.Array:
    return _in_parts(tokens, None)


def _weighed(tokens: pa.Array, weights: pa.Array) -> pa.Array:
    return _in_parts(tokens, weights)


def token_counts(tokens: Column, weights: Column | None = None) -> Column:
    """For each array of tokens its different tokens as (pos, tf, weight): the first place, how often, and the greatest of the weights, an array as long, if given. Null has none, nor have tokens that are null.

    A row is counted where it is, in memory for a bounded number of tokens: neither a table of all tokens of a task nor an
    exchange is needed. Sorting and lambdas of built-in expressions give the same at twice the time.
    """
    if weights is None:
        return F.arrow_udf(_counts, _COUNTS)(tokens)
    return F.arrow_udf(_weighed, _COUNTS)(tokens, weights)


#: Rows (group, field, term) that a task gathers before it adds them up, and of which it hands on all if more than half are left.
GATHERED = 1 << 19
_TERMS = pa.schema([("seg", pa.int32()), ("field", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("total_tf", pa.int64())])


def _term_rows(field: str, words: pa.Array, code: np.ndarray, row: np.ndarray, segs: pa.Array) -> pa.Table:
    """How many rows of each segment hold a word, and how often. code, row: of each token; segs: of each row."""
    segs, n = segs.dictionary_encode(null_encoding="encode"), max(len(words), 1)
    key = np.sort(row * n + code)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, tf = key[first], np.diff(np.append(first, len(key)))
    of = segs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    group = of[key // n] * n + key % n
    order = np.argsort(group, kind="stable")
    group, tf = group[order], tf[order]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    group, df = group[first], np.diff(np.append(first, len(group)))
    total = np.add.reduceat(tf, first) if len(first) else tf
    columns = [segs.dictionary.take(pa.array(group // n)), pa.repeat(pa.scalar(field), len(group)), words.take(pa.array(group % n)), pa.array(df, pa.int64()), pa.array(total, pa.int64())]
    return pa.Table.from_arrays(columns, schema=_TERMS)


def _terms_of(batch: pa.RecordBatch, fields: list[str]) -> Iterator[pa.Table]:
    segs = batch.column(0)
    for field, column in zip(fields, batch.columns[1:], strict=True):
        if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = column.flatten().dictionary_encode()
            code = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            there = code >= 0
            yield _term_rows(field, words.dictionary.cast(pa.string()), code[there], np.repeat(np.arange(len(size)), size)[there], segs)
        else:
            for a, data, ends in _byte_parts(column):
                yield _term_rows(field, *_standard_codes(data, ends), segs.slice(a, len(ends)))


def _added(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["seg", "field", "term"], use_threads=False).aggregate([("df", "sum"), ("total_tf", "sum")]).rename_columns(_TERMS.names).cast(_TERMS)


def term_table(df: DataFrame, seg: Column, texts: dict[str, tuple[Column, str]]) -> DataFrame:
    """(seg, field, term, df, total_tf) of parts of the rows, yet to be summed: in how many rows of a segment a field holds a term, and how often. texts: a field's text and the name of its analyzer.

    Tasks add up over many rows what they count, in bounded memory, so that neither postings nor a row for each of them are made.
    Texts of the standard analyzer are read as bytes, those of others come as arrays of tokens; null has no token, nor are tokens that are null counted.
    """
    fields = list(texts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for rows in _terms_of(batch, fields):
                held.append(rows)
                n += len(rows)
                if n > GATHERED:
                    held = [_added(held)]
                    n = len(held[0])
                    if n > GATHERED // 2:
                        yield from held[0].to_batches()
                        held, n = [], 0
        if held:
            yield from _added(held).to_batches()

    columns = [text if find(name) is ANALYZERS["standard"] else tokens(text, name) for text, name in texts.values()]
    return df.select(seg.cast("int"), *(c.alias(f"c{i}") for i, c in enumerate(columns))).mapInArrow(count, "seg int, field string, term string, df bigint, total_tf bigint")
