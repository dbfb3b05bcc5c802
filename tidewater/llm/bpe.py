"""Byte-level BPE over a public vocabulary: encoding by content-defined chunks, and decoding.

A rolling hash over 16 bytes cuts texts where its low bits are zero, so equal passages
of different documents are cut alike. Each worker encodes a chunk once and keeps its
tokens for every later document with that chunk. A cut may fall inside a word, so each
join is repaired: a window around it, from one sure boundary to another, is encoded
again; where its first and last tokens agree with those the chunks had there, the
window replaces the tokens between, else it is widened, to the whole text if need be.

A sure boundary is white space after a visible ASCII character: no piece of the
pattern holds both, so any tokenisation that covers the place splits there, and what
follows depends only on what follows. The result is exactly that of encoding the
whole text.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import common as C

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW = 16
#: A chunk has 512 bytes on average, and 64 at least.
CUT_BITS, LEAST = 9, 64
#: Bytes of chunks in each of the two generations of a worker's dictionary. A chunk that has been forgotten is encoded again: the bound costs time, never results.
KEPT_BYTES = 6 << 20
#: Bytes of text that are hashed and cut at a time (a longer text alone); it bounds a worker's memory, not the result.
PIECE = 1 << 18


@lru_cache(2)
def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def encoding(path: str = VOCABULARY):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(2)
def lengths(path: str = VOCABULARY) -> list[int]:
    out = [0] * (max(ranks(path).values()) + 1)
    for token, i in ranks(path).items():
        out[i] = len(token)
    return out


def hash_cuts(data: np.ndarray) -> np.ndarray:
    """Places before which the polynomial hash of WINDOW bytes, found by doubling the width, has low bits of zero; PIECE bytes at a time, which bounds the memory and not the result."""
    out = []
    for at in range(0, max(len(data) - WINDOW, 0), PIECE):
        h = data[at : at + PIECE + WINDOW - 1].astype(np.uint64) + np.uint64(1)
        width = 1
        while width < WINDOW:
            with np.errstate(over="ignore"):
                h = h[:-width] * np.uint64(pow(C.BASE_B, width, 1 << 64)) + h[width:]
            width *= 2
        end = np.flatnonzero((C.mix(h) & np.uint64((1 << CUT_BITS) - 1)) == 0) + at + WINDOW
        out.append(end[end < len(data)])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each document the ends of its chunks, from its own start; the last is the document's end."""
    where = hash_cuts(data)
    where = where[(data[where] & 0xC0) != 0x80]
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        got, last = [], a
        inside = where[np.searchsorted(where, a + WINDOW) : np.searchsorted(where, b)]
        i = 0
        while True:
            i += int(np.searchsorted(inside[i:], last + LEAST))
            if i >= len(inside):
                break
            last = int(inside[i])
            got.append(last - a)
        out.append([*got, b - a] if b > a else got)
    return out


class Chunks:
    """Tokens of the chunks seen of late, in two generations."""

    def __init__(self, path: str, kept: int = KEPT_BYTES):
        self.encode, self.kept, self.young, self.old, self.size = encoding(path).encode_ordinary, kept, {}, {}, 0
        self.asked = self.encoded = 0

    def tokens(self, chunk: bytes) -> np.ndarray:
        self.asked += 1
        got = self.young.get(chunk)
        if got is None:
            got = self.old.get(chunk)
            if got is None:
                self.encoded += 1
                got = np.array(self.encode(chunk.decode()), np.int32)
            self.young[chunk] = got
            self.size += len(chunk)
            if self.size > self.kept:
                self.old, self.young, self.size = self.young, {}, 0
        return got


@lru_cache(2)
def chunks(path: str) -> Chunks:
    return Chunks(path)


def sure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of white space after a visible ASCII character."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    visible = (data > 32) & (data < 127)
    flag = np.zeros(len(data), bool)
    flag[1:] = space[1:] & visible[:-1]
    flag[offsets[:-1][offsets[:-1] < len(data)]] = False
    return np.flatnonzero(flag)


def _take(parts: list[np.ndarray], size: int, length: list[int]) -> tuple[int, list[int]] | None:
    """The last tokens of parts that cover size bytes exactly, or None if no tokens do. parts isn't changed."""
    got: list[int] = []
    for part in reversed(parts):
        for end in range(len(part), 0, -16):
            for token in part[max(0, end - 16) : end][::-1].tolist():
                if size <= 0:
                    return (len(got), got[::-1]) if size == 0 else None
                size -= length[token]
                got.append(token)
    return (len(got), got[::-1]) if size == 0 else None


def _head(part: np.ndarray, size: int, length: list[int]) -> list[int] | None:
    got: list[int] = []
    for at in range(0, len(part), 16):
        for token in part[at : at + 16].tolist():
            if size <= 0:
                return got if size == 0 else None
            size -= length[token]
            got.append(token)
    return got if size == 0 else None


def _drop(parts: list[np.ndarray], count: int) -> None:
    while count:
        if len(parts[-1]) <= count:
            count -= len(parts.pop())
        else:
            parts[-1] = parts[-1][:-count]
            count = 0


def _covered(tokens: list[int], size: int, length: list[int], from_end: bool) -> list[int] | None:
    got: list[int] = []
    for token in reversed(tokens) if from_end else tokens:
        if size <= 0:
            break
        size -= length[token]
        got.append(token)
    return None if size else got[::-1] if from_end else got


def encode_document(text: bytes, ends: list[int], bounds: np.ndarray, known: Chunks, length: list[int]) -> np.ndarray:
    """Tokens of one text. ends: of its chunks; bounds: its sure boundaries, ascending."""
    if not ends:
        return np.zeros(0, np.int32)
    parts, at = [known.tokens(text[: ends[0]])], ends[0]
    for end in ends[1:]:
        new = known.tokens(text[at:end])
        width = 2
        while True:
            i = int(np.searchsorted(bounds, at))
            u = int(bounds[i - width]) if i >= width else 0
            u_in = int(bounds[i - width + 1]) if i >= width > 1 else u
            j = i + width - 1
            v = min(int(bounds[j]), end) if j < len(bounds) else end
            v_in = min(int(bounds[j - 1]), end) if j < len(bounds) and j else v
            left, right = _take(parts, at - u, length), _head(new, v - at, length)
            if left is not None and right is not None:
                again = known.encode(text[u:v].decode())
                first, last = _covered(again, u_in - u, length, False), _covered(again, v - v_in, length, True)
                whole = u == 0 and v == end
                agree = first is not None and last is not None and first == left[1][: len(first)] and (v == end or (len(last) <= len(right) and last == right[len(right) - len(last) :]))
                if agree or whole:
                    _drop(parts, left[0])
                    parts += [np.array(again, np.int32), new[len(right) :]]
                    break
            elif u == 0 and v == end:
                parts = [np.array(known.encode(text[:end].decode()), np.int32)]
                break
            width *= 2
        at = end
    return np.concatenate(parts)


def encode_array(column: pa.Array, path: str = VOCABULARY, known: Chunks | None = None) -> list[np.ndarray]:
    known, length = known or chunks(path), lengths(path)
    data, offsets = C.utf8(column)
    out = []
    for a, b in C.pieces(offsets, PIECE):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        bounds, all_ends = sure(part, off), cuts(part, off)
        blob, first = part.tobytes(), np.searchsorted(bounds, off).tolist()
        for k, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            out.append(encode_document(blob[s:e], all_ends[k], bounds[first[k] : first[k + 1]] - s, known, length))
    return out


def _lists(arrays: list[np.ndarray], missing: pa.Array | None = None) -> pa.ListArray:
    offs = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, pa.int32()), mask=missing) if missing is not None else pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, pa.int32()))


@lru_cache(2)
def _table(path: str) -> list[bytes | None]:
    out: list[bytes | None] = [None] * len(lengths(path))
    for token, i in ranks(path).items():
        out[i] = token
    return out


def decode_tokens(tokens: list[int], path: str = VOCABULARY) -> bytes | None:
    """The tokens' bytes, or None if one of them isn't in the vocabulary."""
    table = _table(path)
    try:
        return b"".join([table[i] for i in tokens]) if min(tokens, default=0) >= 0 else None
    except (IndexError, TypeError):
        return None


def bpe_encode(text: Column, path: str = VOCABULARY) -> Column:
    """array<int> of token ids. Null stays null, empty text has no tokens, special tokens' strings are ordinary text."""

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        return _lists(encode_array(column, path), column.is_null())

    return run(text)


def bpe_decode(tokens: Column, path: str = VOCABULARY) -> Column:
    """The text of token ids; bytes that aren't UTF-8 become U+FFFD. Null stays null, as does a list with a null or an unknown id."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        offs, values = column.offsets.to_pylist(), column.values
        out = []
        for i, ok in enumerate(column.is_valid().to_pylist()):
            got = decode_tokens(values[offs[i] : offs[i + 1]].to_pylist(), path) if ok and values[offs[i] : offs[i + 1]].null_count == 0 else None
            out.append(None if got is None else got.decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return run(tokens)


def encode_documents(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, source if docs has it, n_tokens, tokens, intact) for every row; intact: decoding the tokens gives the text back byte for byte.

    One pass without a shuffle; rows stay in place, repeated rows are encoded alike, null text has null tokens, count and intact,
    empty text no tokens. Texts of any length are encoded whole. An empty table gives no rows. Other columns are left out.
    """

    @F.arrow_udf("tokens array<int>, n_tokens int, intact boolean")
    def run(column: pa.Array) -> pa.Array:
        arrays, missing = encode_array(column, path), column.is_null()
        table, data, offsets = _table(path), *C.utf8(column)
        blob, same = memoryview(data), []
        for k, tokens in enumerate(arrays):
            same.append(b"".join([table[i] for i in tokens.tolist()]) == blob[offsets[k] : offsets[k + 1]])
        gone = np.asarray(missing)
        return pa.StructArray.from_arrays([_lists(arrays, missing), pa.array([len(x) for x in arrays], pa.int32(), mask=gone), pa.array(same, pa.bool_(), mask=gone)], ["tokens", "n_tokens", "intact"])

    columns = [F.col(id_col).alias("doc_id"), *([F.col("source")] if "source" in docs.columns else [])]
    return docs.select(*columns, run.asNondeterministic()(F.col(text)).alias("e")).select("doc_id", *(["source"] if "source" in docs.columns else []), "e.n_tokens", "e.tokens", "e.intact")
