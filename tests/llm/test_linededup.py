import random

import pytest

from tidewater.llm import linededup as L

SCHEMA = "doc_id bigint, text string, n_chars bigint, lines string, tw_mask string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "p", "q") for i, t in rows], SCHEMA)


def brute(rows, need):
    docs = {}
    for i, t in rows:
        docs[(i, t)] = [(n, x) for n, x in enumerate((t or "").split("\n")) if x.strip()]
    places = [(k, i) for k, seq in docs.items() for i in range(len(seq))]
    same = lambda a, b: next((n for n in range(10**9) if a[1] + n >= len(docs[a[0]]) or b[1] + n >= len(docs[b[0]]) or docs[a[0]][a[1] + n][1] != docs[b[0]][b[1] + n][1]), 0)
    gone, longest = {k: set() for k in docs}, dict.fromkeys(docs, 0)
    order = lambda p: (p[0][0] is None, p[0][0] or 0, p[0][1] or "", p[1])
    for a in places:
        for b in places:
            if a != b:
                n = same(a, b)
                if n >= 2:
                    longest[a[0]] = max(longest[a[0]], n)
                if n >= need and order(b) < order(a):
                    gone[a[0]] |= set(range(a[1], a[1] + n))
    out = []
    for k in rows:
        seq = docs[tuple(k)]
        lost = {seq[i][0] for i in gone[tuple(k)]}
        if lost and len(lost) == len(seq):
            continue
        text = k[1] if not lost else "\n".join(x for n, x in enumerate(k[1].split("\n")) if n not in lost)
        out.append((k[0], text, len(lost), longest[tuple(k)]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,need", [(0, 2), (1, 2), (2, 1), (3, 3), (4, 4)])
def test_equals_brute_force(spark, seed, need):
    rnd = random.Random(seed)
    blocks = [[rnd.choice("abcdefgh") * 3 if rnd.random() < 0.4 else f"line {rnd.random()}" for _ in range(rnd.randint(1, 7))] for _ in range(6)]
    rows = []
    for i in range(24):
        lines = []
        for _ in range(rnd.randint(1, 3)):
            lines += rnd.choice(blocks) if rnd.random() < 0.7 else [f"only {rnd.random()}", ""]
        rows.append((i, "\n".join(lines)))
    got = [(r.doc_id, r.text, r.lines_deleted, r.longest_run) for r in L.line_dedup(frame(spark, rows), need, with_runs=True).collect()]
    assert sorted(got, key=repr) == brute(rows, need)


def test_edge_cases(spark):
    long = "\n".join(f"x{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \n\n"), (4, "a\nb\n\nc"), (4, "a\nb\n\nc"), (None, "a\nb\nd"), (5, "z\n\na\nb"), (6, "r\n" * 70), (7, long), (8, long), (9, "a\nb")]
    docs = frame(spark, rows)
    out = L.line_dedup(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=repr)
    want = [(1, None, 0), (2, "", 0), (3, " \n\n", 3), (4, "a\nb\n\nc", 6), (4, "a\nb\n\nc", 6), (None, "d", 1), (5, "z\n", 2), (6, "r\n", 2), (7, long, len(long))]
    assert got == sorted(want, key=repr)
    assert L.line_dedup(docs.limit(0)).count() == 0


def test_long_single_lines(spark):
    """A long line between lines that differ, and as a whole document; a run of two lines beside it goes as before."""
    import corpus_pipeline

    long, other = " ".join(f"w{i}" for i in range(50)), "\t".join(f"v{i}" for i in range(49))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n\n{long}\nd\n{other}"), (3, long), (4, f"e\n{other}\nf"), (5, f"g\n{long}\n{long}\nb"), (6, f"{long} more"), (None, f"h\n{long}"), (8, f"{long}\nb\ni")]
    docs = frame(spark, rows)
    want = [(1, f"a\n{long}\nb"), (2, f"c\n\nd\n{other}"), (4, f"e\n{other}\nf"), (5, "g"), (6, f"{long} more"), (8, "i"), (None, "h")]
    for out in (L.line_dedup(docs), corpus_pipeline.line_stage(spark, docs, "")):
        got = [(r.doc_id, r.text, r.n_chars) for r in out.collect()]
        assert sorted(got, key=repr) == sorted(((i, t, len(t)) for i, t in want), key=repr)
    # without them, runs of two lines alone
    assert L.line_dedup(docs, long_words=None).where("doc_id = 3").count() == 1


def test_array_is_sorted(spark):
    rows = [(1, "b\na\nb\na\nc"), (2, "a\nb\na"), (3, "c\nq")]
    seqs, intervals, array, firsts = L.suffix_array(frame(spark, rows), 2)
    ids = {r.doc_id: list(zip(r.hi, r.lo)) for r in seqs.collect()}
    places = [(r.doc_id, r.i) for r in array.orderBy("rank").collect()]
    seen = [x for s in ids.values() for x in s]
    assert sorted(r.rank for r in array.collect()) == list(range(len(places)))
    heads = [ids[d][i] for d, i in places]
    assert heads == sorted(heads)
    pairs = [[x for x in ids[d][i : i + 2]] for d, i in places]
    full = [p for p in pairs if len(p) == 2 and all(seen.count(x) > 1 for x in p)]
    assert full == sorted(full)
    groups = {}
    for r in intervals.collect():
        groups.setdefault(r.rank, []).append(tuple(ids[r.doc_id][r.i : r.i + 2]))
    assert groups and all(len(g) > 1 and len(set(g)) == 1 and g[0] == tuple(pairs[rank]) for rank, g in groups.items())
    lcp = {(r.doc_id, r.i, r.before_id, r.before_i): r.lcp for r in L.longest_common(array, firsts).collect()}
    assert 3 in lcp.values() and all(ids[a][i : i + n] == ids[b][j : j + n] and ids[a][i : i + n + 1] != ids[b][j : j + n + 1] or i + n == len(ids[a]) or j + n == len(ids[b]) for (a, i, b, j), n in lcp.items())


@pytest.mark.parametrize("need", [2, 3, 5])
def test_short_and_whole_array_delete_the_same(spark, need):
    rnd = random.Random(need)
    block = [f"b{i}" for i in range(9)]
    rows = [(f"d{i:02}", "\n".join(block[rnd.randint(0, 4) : rnd.randint(5, 9)] + [f"u{i}"] + block[: rnd.randint(0, 6)])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    whole = {(r.doc_id, r.text) for r in L.line_dedup(docs, need, with_runs=True).collect()}
    assert whole == {(r.doc_id, r.text) for r in L.line_dedup(docs, need).collect()} == {r[:2] for r in brute(rows, need)}


def test_a_common_line_does_not_fill_one_task(spark, monkeypatch):
    """One line in half of all documents, with another line behind it in each: the groups that the windows of the sums get stay as small as they are set, whatever the line's share."""
    monkeypatch.setattr(L, "GROUP", 3)
    rows = [(i, f"common\nsecond {i % 100}\nthird {i % 25}\nown {i}" if i % 2 else f"only {i}\nmine {i}") for i in range(400)]
    sizes = []
    over = L.Window.partitionBy

    def watched(*by):
        sizes.append(by)
        return over(*by)

    monkeypatch.setattr(L.Window, "partitionBy", staticmethod(watched))
    got = [(r.doc_id, r.text, r.lines_deleted, r.longest_run) for r in L.line_dedup(frame(spark, rows), with_runs=True).collect()]
    assert sorted(got, key=repr) == brute(rows, 2)
    # windows over a rank alone are those of the groups' totals, one row for 2 ** GROUP ranks
    assert {by for by in sizes if all(isinstance(c, str) for c in by) and "rank" in by} == {("rank",), ("rank", "g")}
