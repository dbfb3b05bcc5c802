import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import bpe as B
from tidewater.llm import tokencount as T

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(B.VOCABULARY), reason="no vocabulary here")
ODD = ["", " ", "   ", "\n\n \t", "a", "it's we'll 'll l", "é" * 300, "a" * 5000, " " * 3000, "日本語テキスト" * 100, "x y  z", "<|endoftext|>", "0123456789" * 200, "#$%" * 400, "\x1c \x1d a", "👍🏽" * 90]


def texts(seed, n=60):
    rnd = random.Random(seed)
    pool = ["the ", "cat", " sat", "'s", "'", "l", "  ", "\n", "é", "日本", "👍", "12", ".", "!!", "thhahe", "\t", "Z", " ", "ll "]
    shared = ["".join(rnd.choices(pool, k=rnd.randint(1, 900))) for _ in range(5)]
    return ["".join(rnd.choice(shared) if rnd.random() < 0.3 else "".join(rnd.choices(pool, k=rnd.randint(1, 300))) for _ in range(rnd.randint(1, 8))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_chunked_encoding_is_exact(seed):
    rows = texts(seed) + ODD
    known = B.Chunks(B.VOCABULARY, kept=4000 if seed else B.KEPT_BYTES)
    got = B.encode_array(pa.array(rows), known=known)
    want = [B.encoding().encode_ordinary(t) for t in rows]
    assert [x.tolist() for x in got] == want
    assert [B.decode_tokens(x.tolist()).decode() for x in got] == rows


def test_shared_chunks_are_encoded_once():
    known = B.Chunks(B.VOCABULARY)
    doc = "".join(random.Random(3).choices("abcdefg hijkl mnop", k=20_000))
    B.encode_array(pa.array([doc]), known=known)
    before = known.encoded
    B.encode_array(pa.array(["A new start. " + doc, doc + " and a new end"]), known=known)
    assert before > 20 and known.encoded - before <= 6


def test_cuts_depend_on_content():
    doc = "".join(random.Random(4).choices("abcdefg hijkl mnop é", k=9000))
    one, two = (np.frombuffer(t.encode(), np.uint8) for t in (doc, "prefix " * 9 + doc))
    a, b = B.cuts(one, np.array([0, len(one)]))[0], B.cuts(two, np.array([0, len(two)]))[0]
    assert len(a) > 5 and len({x + 63 for x in a} & set(b)) >= len(a) - 3


def test_encode_documents(spark):
    rows = [(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (None, "x"), *((i + 10, t) for i, t in enumerate(ODD))]
    docs = spark.createDataFrame([(*r, 7, "s") for r in rows], "doc_id bigint, text string, tokens int, e string")
    out = B.encode_documents(docs).collect()
    assert len(out) == len(rows) and [r.doc_id for r in out if r.tokens is None] == [1] == [r.doc_id for r in out if r.intact is None]
    assert all(r.intact for r in out if r.doc_id != 1)
    assert next(r for r in out if r.doc_id == 3).tokens == B.encoding().encode_ordinary("Hello world")
    assert B.encode_documents(docs.limit(0)).count() == 0
    back = docs.select("text", B.bpe_decode(B.bpe_encode(F.col("text"))).alias("b")).collect()
    assert all(r.text == r.b for r in back)
    bad = spark.createDataFrame([([1, None],), ([10**6],), ([-1],), (None,), ([],)], "t array<int>").select(B.bpe_decode(F.col("t")).alias("b")).collect()
    assert [r.b for r in bad] == [None, None, None, None, ""]


@pytest.mark.parametrize("seed", range(3))
def test_merges_equal_the_library(seed):
    e, table = B.encoding(), B.ranks()
    for t in texts(seed, 10) + ODD:
        for piece in set(T.pattern().findall(t)):
            if len(piece) < 400:
                assert T.merge(piece.encode(), table) == e.encode_ordinary(piece)


def test_proof_covers_what_it_should():
    known = T.proven()
    assert " the" in known and "'s" in known and len(known) > 45_000
    e = B.encoding()
    assert all(len(e.encode_ordinary(t)) == 1 for t in list(known)[:3000])


def test_token_counts(spark):
    rows = [(1, None), (2, ""), (None, "It's"), *((i + 10, t) for i, t in enumerate(ODD + texts(9, 20)))]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: r for r in T.token_counts(docs).collect()}
    e = B.encoding()
    for i, t in rows:
        assert got[i].n_tokens == (None if t is None else len(e.encode_ordinary(t)))
        assert t is None or got[i].n_pieces == len(T.pattern().findall(t)) >= got[i].n_whole
    assert T.token_counts(docs.limit(0)).count() == 0
    small = T.Counter(B.VOCABULARY, T.proven(), remembered=3)
    assert all(small.count(t)[2] == len(e.encode_ordinary(t)) for t in texts(2, 10))
