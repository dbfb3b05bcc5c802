import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import common as C
from tidewater.llm import minhash as M

SCHEMA = "doc_id bigint, text string, source string, head string, sig string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", "x", "y") for i, t in rows], SCHEMA)


def matches(rows, need, k=M.K):
    """The distinct documents, in order, and the pairs of their places with enough collisions."""
    import pyarrow as pa

    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sig, has = M.signatures_of(*C.utf8(pa.array([t for _, t in rows], pa.string()), lower=True), k, M.SHINGLE)
    return rows, [(j, i) for i in range(len(rows)) for j in range(i) if has[i] and has[j] and int((sig[i] == sig[j]).sum()) >= need]


def brute(rows, need, k=M.K):
    """(doc_id, class_id, links) by comparing all with all."""
    rows, pairs = matches(rows, need, k)
    least, links = groups(pairs), {}
    for p in pairs:
        for x in p:
            links[x] = links.get(x, 0) + 1
    return sorted(((rows[x][0], rows[least[x]][0], n) for x, n in links.items()), key=repr)


def kept(rows, need=28):
    """The rows that stay where ids are distinct and not null."""
    docs, pairs = matches(rows, need)
    least = groups(pairs)
    stay = {docs[x] for x in range(len(docs)) if least.get(x, x) == x}
    return [r for r in rows if r in stay]


def found(df, **options):
    return sorted((tuple(r) for r in M.near_duplicates(df, **options).collect()), key=repr)


def mixed(seed, groups=25):
    rnd = random.Random(seed)
    rows, vocab = [], [f"w{i}" for i in range(200)]
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 40, 120]))]
        for _ in range(rnd.choice([1, 2, 7])):
            copy = [w if rnd.random() > 0.04 else rnd.choice(vocab) for w in base] if rnd.random() < 0.7 else base
            rows.append((len(rows) * 3 - 20, " ".join(copy)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = mixed(seed)
    got = found(frame(spark, rows))
    assert got == brute(rows, 28) and max(r[2] for r in got) > 3
    assert sorted(r.doc_id for r in M.near_dedup(frame(spark, rows)).collect()) == sorted(i for i, _ in kept(rows))


@pytest.mark.parametrize("part, small", [(4096, 8), (16, 4), (7, 48)])
def test_long_lists_are_cut(spark, monkeypatch, part, small):
    """One group of near copies with nearly all rows, all of them different, and copies of some."""
    monkeypatch.setattr(M, "PART", part)
    monkeypatch.setattr(M, "SMALL", small)
    rnd = random.Random(part)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(60)]
    rows = [(i, " ".join(w if rnd.random() > 0.05 else f"z{rnd.randint(0, 10**6)}" for w in base)) for i in range(90)]
    rows += [(200 + i, rows[i % 7][1]) for i in range(20)] + [(300 + i, t) for i, t in mixed(9, 8)]
    need = M._need(M.K, M.THRESHOLD)
    assert found(frame(spark, rows)) == brute(rows, need)
    assert sorted(r.doc_id for r in M.near_dedup(frame(spark, rows)).collect()) == sorted(i for i, _ in kept(rows))


def test_merges_of_lists(monkeypatch):
    """The three ways to merge a list agree, on lists in one part and in two."""
    import pyarrow as pa

    rnd = random.Random(1)
    bases = [[f"w{rnd.randint(0, 10**6)}" for _ in range(60)] for _ in range(3)]
    texts = [" ".join(w if rnd.random() > 0.06 else f"z{rnd.randint(0, 10**6)}" for w in bases[i % 3]) for i in range(70)]
    sig, _ = M.signatures_of(*C.utf8(pa.array(texts)), M.K, M.SHINGLE)
    n = len(texts)
    full = np.full(n, (1 << 64) - 1, np.uint64)
    for bit in (0, 5):
        sig[:, bit] = 7  # the list's own coordinate
        for parts in (np.zeros(n, np.int64), np.arange(n) % 2):
            out = {}
            for way in ("small", "large", "reach"):
                m = M.Merge(np.arange(n), sig, full, np.full(n, bit, np.uint64), parts, np.ones(n, np.int64), 28, way != "reach")
                monkeypatch.setattr(M, "SMALL", n if way == "small" else 1)
                m.run(np.array([0]), np.array([n]), np.full(n, not parts.any()))
                out[way] = (m.label.tolist(), m.links.tolist())
            assert out["small"] == out["large"]
            assert bit or out["reach"][0] == out["small"][0]
            assert set(out["reach"][0]) == {0, 1, 2} or parts.any()


def test_copies_of_copies(spark):
    """Copies of one text next to near copies of it, that have copies themselves: every link counts, not only those of the heads."""
    base = [f"w{i}" for i in range(80)]
    near = " ".join(base[:-1] + ["other"])
    rows = [(i, " ".join(base)) for i in (1, 4, 6, 9)] + [(i, near) for i in (2, 5, 7)] + [(11, " ".join(["first"] + base[1:]))]
    got = found(frame(spark, rows))
    assert got == brute(rows, 28) and {r[1:] for r in got} == {(1, 7)}
    # one id with two texts that are near copies: two documents
    twice = [(1, " ".join(base)), (1, near), (3, " ".join(base)), (2, near), (2, near)]
    assert found(frame(spark, twice)) == brute(twice, 28) == [(1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 1, 3)]


def test_edge_cases(spark):
    long = "lorem " + " ".join(f"x{i}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, "?!"), (None, "a b c"), (None, "a B c."), (4, "One word."), (5, "one WORD"), (5, "one WORD"), (6, long), (7, long + " end"), (8, "solo"), (8, "other text here")]
    assert found(frame(spark, rows)) == brute(rows, 28) == [(4, 4, 1), (5, 4, 1), (6, 6, 1), (7, 6, 1), (None, None, 1), (None, None, 1)]
    assert M.near_duplicates(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        M.near_duplicates(frame(spark, rows), k=65)
    named = frame(spark, rows).withColumn("doc_id", F.concat(F.lit("id-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("x"))))
    assert [r[:2] for r in found(named)] == [("id-4", "id-4"), ("id-5", "id-4"), ("id-6", "id-6"), ("id-7", "id-6"), ("id-x", "id-x"), ("id-x", "id-x")]
    stays = sorted(r.doc_id for r in M.near_dedup(named).collect())
    assert stays == ["id-1", "id-2", "id-3", "id-4", "id-6", "id-8", "id-8", "id-x"]


def test_word_and_prefix_hashes():
    data = np.frombuffer("ab ab,a bé bé".encode(), np.uint8)
    starts, ends, first = C.words(data, np.array([0, 4, len(data)]))
    h = C.word_hashes(data, starts, ends)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"ab", b"a", b"b", b"a", "bé".encode(), "bé".encode()]
    assert h[4] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 4 and list(first) == [0, 2, 6]
    p, power = C.prefix_hashes(h, C.BASE_B), C.powers(C.BASE_B, 10)
    span = lambda a, b: C.span_hashes(p, np.array([a]), np.array([b]), power)[0]
    assert span(4, 5) == span(5, 6) and span(1, 2) == span(3, 4) and span(0, 1) != span(2, 3)


def groups(pairs):
    """Least id of every id's component."""
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(least)}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(rnd.randint(0, 90), rnd.randint(0, 90)) for _ in range(60)] + [(500, 400), (400, 500), (7, 7)]
    df = spark.createDataFrame(pairs, "doc_a bigint, doc_b bigint")
    got = {r.id: r.least for r in M.components(df, C.Scratch(spark)).collect()}
    assert got == {x: y for x, y in groups(pairs).items() if x != y}
    assert M.components(df.limit(0), C.Scratch(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    rnd = random.Random(5)
    base = [[f"w{rnd.randint(0, 10**6)}" for _ in range(80)] for _ in range(6)]
    rows = []
    for b in base:
        for k in range(5):
            rows.append((len(rows), " ".join(w if k == 0 or rnd.random() > 0.02 else "zz" for w in b)))
    rows += [(900, None), (901, ""), (None, rows[0][1]), (902, "alone here"), (902, "alone here"), (None, "nothing like it"), (3, rows[3][1])]
    df = frame(spark, rows)
    out = M.near_dedup(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(kept(rows), key=repr)
    assert len(kept(rows)) == 6 + 5
    assert M.near_dedup(df.limit(0)).count() == 0


def test_recall_of_true_likeness(spark):
    """Pairs whose sets of shingles overlap by 0.6 or more, found by comparing all with all."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(len(w) - 2, 1))} if w else set()
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    shared = {}
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                p = (min(ids[a], ids[b]), max(ids[a], ids[b]))
                shared[p] = shared.get(p, 0) + 1
    like = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    own = {r[0]: r[1] for r in found(docs)}
    close = [p for p, j in like.items() if j >= 0.6]
    assert close and np.mean([p[0] in own and own[p[0]] == own.get(p[1]) for p in close]) > 0.95
    best = {}
    for (a, b), j in like.items():
        best[a], best[b] = max(best.get(a, 0), j), max(best.get(b, 0), j)
    assert all(best.get(i, 0) > 0.2 for i in own)
