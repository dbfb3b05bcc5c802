import random
import re

import numpy as np
import pytest

from tidewater.llm import common as C
from tidewater.llm import suffixdedup as S

SCHEMA = "doc_id bigint, text string"


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())


def brute(rows, m, key):
    """Of every (doc_id, text): repeated words and words with an earlier copy, as sets of places."""
    docs = {(i, t) for i, t in rows if t is not None}
    at = {}
    for i, t in docs:
        w = words(t)
        for p in range(len(w) - m + 1):
            at.setdefault(tuple(w[p : p + m]), []).append(((i is None, i or 0, key[t], p), i, t, p))
    some, later = {}, {}
    for places in at.values():
        if len(places) > 1:
            least = min(places)
            for x in places:
                some.setdefault(x[1:3], set()).update(range(x[3], x[3] + m))
                if x is not least:
                    later.setdefault(x[1:3], set()).update(range(x[3], x[3] + m))
    return some, later


def compare(spark, rows, m):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    key = {r.text: r.k for r in df.select("text", C.text_key().alias("k")).collect()}
    text = {k: t for t, k in key.items()}
    some, later = brute(rows, m, key)
    got_some, got_later = {}, {}
    for r in S.repeated_passages(df, m).collect():
        own = (r.doc_id, text[r.text_key])
        fresh = set(range(r.start_word, r.end_word))
        assert not fresh & got_some.get(own, set())
        got_some.setdefault(own, set()).update(fresh)
        for c in r.cuts:
            got_later.setdefault(own, set()).update(range(c.start, c.end))
        if not r.cuts:
            assert r.copy_of is None
    assert got_some == some
    assert got_later == later
    return some


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["alpha", "été", "Beta", "gamma9", "дом", "x", "delta", "nu"]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 60))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 30))))
        text = rng.choice([" ", ", ", "\n"]).join(parts)
        if rng.random() < 0.3 and rows:  # an edited copy
            w = words(rows[-1][1] or "")
            for _ in range(len(w) // 15):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
            text = " ".join(w)
        rows.append((i, text))
    return rows + rows[:3] + [(None, rows[4][1]), (None, None), (7000, None), (7001, ""), (7002, "!!"), (5, rows[6][1]), (7003, "na " * 100), (7004, "ab cd " * 40)]


@pytest.mark.parametrize("m,seed", [(6, 1), (9, 2), (20, 3)])
def test_equals_brute_force(spark, m, seed):
    assert compare(spark, corpus(seed, 60), m)


def test_many_copies_and_a_shared_passage_of_the_least_length(spark):
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"w{rng.randint(0, 10**7)}" for _ in range(n))
    short, long, copy = fresh(10), fresh(9), fresh(80)
    rows = [(i, f"{fresh(20)} {short} {fresh(20)}") for i in range(40)] + [(100 + i, f"{fresh(20)} {long} {fresh(20)}") for i in range(40)] + [(200 + i, copy) for i in range(300)]
    some = compare(spark, rows, 10)
    assert {i for i, _ in some} == {*range(40), *range(200, 500)}


@pytest.mark.parametrize("m", [6, 20])
def test_hot_anchors_are_cut_into_passages(spark, m, monkeypatch):
    """With a bound of one class every anchor that repeats is hot: the result is the same."""
    was = S._classify
    monkeypatch.setattr(S, "HOT", 1)
    monkeypatch.setattr(S, "_classify", lambda batches: was(batches))  # goes to the workers by value, the bound with it
    compare(spark, corpus(m, 50), m)


def test_classify_streams(monkeypatch):
    """Batches that end anywhere give the same kinds, whether a group becomes hot or not."""
    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted((g, c, 0, i) for g in range(6) for c in range(rng.choice([1, 2, 9, 30])) for i in range(rng.choice([1, 1, 3])))
    cols = list(zip(*rows))
    table = pa.table({"g": pa.array(cols[0], pa.int64()), "c": pa.array(cols[1], pa.int64()), "d": pa.array(cols[2], pa.int64()), "doc_id": pa.array([f"d{i}" for i in range(len(rows))]), "th": pa.array([7] * len(rows), pa.int64()), "at": pa.array(cols[3], pa.int32()), "before": pa.array([0] * len(rows), pa.int32()), "after": pa.array([9] * len(rows), pa.int32())})
    for hot in (4, 100):
        monkeypatch.setattr(S, "HOT", hot)
        got = [sorted(str(r) for b in S._classify(iter(table.to_batches(n))) for r in b.to_pylist()) for n in (1, 2, 5, 10_000)]
        assert got[0] == got[1] == got[2] == got[3]
        kinds = {r["kind"] for b in S._classify(iter(table.to_batches())) for r in b.to_pylist()}
        assert (3 in kinds) == (hot == 4)


def test_ids_of_another_type(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([("b", text), ("a", "x " + text), (None, text)], "doc_id string, text string")
    got = sorted(((r.doc_id, r.copy_of, r.start_word, len(r.cuts)) for r in S.repeated_passages(df).collect()), key=repr)
    assert got == [("a", None, 1, 0), ("b", "a", 0, 1), (None, "a", 0, 1)] or got == [("a", None, 1, 0), ("b", "a", 0, 1), (None, "b", 0, 1)]


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.repeated_passages(df).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    wide = spark.createDataFrame([(1, text, "a", 3), (2, text, "b", 4)], "doc_id bigint, text string, g string, words int")
    (row,) = [r for r in S.repeated_passages(wide).collect() if r.cuts]
    assert (row.doc_id, row.copy_of, row.start_word, row.end_word) == (2, 1, 0, 60)


def test_a_very_long_text(spark):
    long = " ".join(f"v{i}" for i in range(300_000))
    rows = [(1, long), (2, "head " + long)]
    got = sorted((r.doc_id, r.start_word, r.end_word, len(r.cuts)) for r in S.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 0, 300_000, 0), (2, 1, 300_001, 1)]


def test_cut_later(spark):
    passage = " ".join(f"P{i}" for i in range(50))
    rows = [(1, f"one {passage} two", 0), (2, f"three, {passage}! four", 0), (3, passage, 0), (4, None, 7), (5, "clean", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in S.cut_later(df, S.repeated_passages(df)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("three, ! four", 13), 4: (None, 7), 5: ("clean", 5)}


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 3, 400).astype(np.uint64)
    start = rng.integers(0, 380, 90)
    end = np.minimum(start + rng.integers(0, 40, 90), 400)
    s = S.Suffixes(h, start, end)
    size = np.array([1, 50, 2, 37])
    at = np.concatenate(([0], np.cumsum(size)[:-1]))
    order = s.sort(at, size)
    for a, n in zip(at, size):
        assert [(tuple(h[start[i] : end[i]]), i) for i in order[a : a + n]] == sorted((tuple(h[start[i] : end[i]]), i) for i in range(a, a + n))


def test_colliding_hashes_are_found_and_redone():
    words_ = [" ".join(f"{c}{i}" for i in range(10)) + " " for c in "ab"]
    blobs = [words_[0].encode(), words_[1].encode(), words_[0].encode()]
    same = lambda data, ws, we: np.arange(len(ws), dtype=np.uint64) % np.uint64(10)  # noqa: E731  words of one place collide
    got = S.resolve(blobs, np.zeros(3, np.int64), np.zeros(3, np.int64), np.arange(3), 10, hashes=same)
    assert got[1].tolist() == [0, -1, 0] and got[3].tolist() == [-1, -1, 0] and got[4].tolist() == [-1, -1, 0]
