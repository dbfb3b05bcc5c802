"""Token counts with a shortcut for whole tokens.

Offline, once for a vocabulary, each of its strings is put through the pattern and
the merges: those that are one piece and merge to one token are proven. In a text,
a piece (pre-token) that is proven counts one without merging; only the others are
merged, each distinct one once per worker while it is remembered.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.bpe import PATTERN, VOCABULARY, encoding, ranks

#: Pieces remembered by a worker before it starts afresh; a forgotten piece is merged again.
REMEMBERED = 300_000


def merge(piece: bytes, table: dict[bytes, int]) -> list[int]:
    """Byte-pair merges of one piece: the pair of lowest rank first, the leftmost of equals, as the definition has it."""
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := table.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, x, y = heapq.heappop(heap)
        j = after[i]
        if parts[i] is not x or j >= len(parts) or parts[j] is not y:
            continue
        parts[i], parts[j] = x + y, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else len(parts)
            if b < len(parts) and (r := table.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a], parts[b]))
    return [table[p] for p in parts if p is not None]


@lru_cache(2)
def pattern():
    import regex

    return regex.compile(PATTERN)


@lru_cache(2)
def proven(path: str = VOCABULARY) -> frozenset[str]:
    """The vocabulary strings that are one piece of the pattern and that the merges make one token, which is their own."""
    out, find, table = [], pattern().fullmatch, ranks(path)
    for token, i in table.items():
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        if pattern().findall(text) == [text] and find(text) and merge(token, table) == [i]:
            out.append(text)
    return frozenset(out)


class Counter:
    def __init__(self, path: str, known: frozenset[str], remembered: int = REMEMBERED):
        self.known, self.merge, self.remembered, self.seen = known, encoding(path)._encode_single_piece, remembered, {}

    def count(self, text: str) -> tuple[int, int, int]:
        """(pieces, of these counted by the shortcut, tokens)."""
        pieces = pattern().findall(text)
        rest = [p for p in pieces if p not in self.known]
        total, seen = len(pieces) - len(rest), self.seen
        for p in rest:
            n = seen.get(p)
            if n is None:
                if len(seen) >= self.remembered:
                    seen.clear()
                n = seen[p] = len(self.merge(p))
            total += n
        return len(pieces), len(pieces) - len(rest), total


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_pieces, n_whole, n_tokens) for every row: pieces, those counted without merging, and tokens in all.

    Counts equal the length of the encoding of the whole text. Null text has null counts, empty text zeros. Repeated rows are
    counted alike, an empty table gives no rows, and other columns are left out. The proof is made on the driver, from the
    vocabulary alone, and sent along (at most as many strings as that has).
    """
    known = docs.sparkSession.sparkContext.broadcast(proven(path))

    @F.arrow_udf("n_pieces int, n_whole int, n_tokens int")
    def run(column: pa.Array) -> pa.Array:
        counter = _COUNTERS.get(path)
        if counter is None:
            counter = _COUNTERS[path] = Counter(path, known.value)
        rows = np.array([counter.count(t) if t is not None else (0, 0, 0) for t in (x.as_py() for x in column)], np.int32).reshape(-1, 3)
        gone = np.asarray(column.is_null())
        return pa.StructArray.from_arrays([pa.array(rows[:, i], mask=gone) for i in range(3)], ["n_pieces", "n_whole", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), run.asNondeterministic()(F.col(text)).alias("c")).select("doc_id", "c.*")


