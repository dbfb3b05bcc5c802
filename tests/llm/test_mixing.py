from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import mixing as M

SCHEMA = "doc_id bigint, text string, source string, shard string, s string, tw_h int"


def frame(spark, rows):
    return spark.createDataFrame([(i, "t", s, "x", "y", 1) for i, s in rows], SCHEMA)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    got = M.permuted(np.arange(n), n, 5)
    assert sorted(got) == list(range(n))
    assert n < 1000 or (not np.array_equal(got, M.permuted(np.arange(n), n, 6)) and abs(np.corrcoef(got, np.arange(n))[0, 1]) < 0.1)


def test_quotas():
    assert M.quotas({"a": 10, "b": 100}, {"a": 1, "b": 1}) == {"a": 10, "b": 10}
    assert M.quotas({"a": 10, "b": 100, None: 50}, {"a": 0.2, "b": 0.5, None: 0.3}) == {"a": 10, "b": 25, None: 15}
    assert sum(M.quotas({"a": 7, "b": 7, "c": 7}, {"a": 1, "b": 1, "c": 0.7}).values()) == 18
    assert M.quotas({"a": 7}, {}) == {}


@pytest.mark.parametrize("shards", [1, 2, 5, 13])
def test_tree_shares_out_everything(shards):
    quota = np.array([50, 0, 7, 200])
    ends = np.zeros(4, int)
    for shard in range(shards):
        first, n = M.leaf(quota, shards, shard, 3)
        assert (first == ends).all() and (n >= 0).all()
        ends = first + n
        assert abs(n.sum() - 257 / shards) < 3
    assert (ends == quota).all()


def test_draws_follow_the_distribution():
    quota, got = np.array([30, 70]), []
    for seed in range(3000):
        got.append(M.leaf(quota, 4, 1, seed)[1][0])
    # of 100 blocks 25 fall in each shard: mean n K / N, variance n K/N (1 - K/N) (N - n)/(N - 1)
    assert np.mean(got) == pytest.approx(7.5, abs=0.15)
    assert np.var(got) == pytest.approx(25 * 0.3 * 0.7 * 75 / 99, rel=0.12)


def reference(docs, **kw):
    """{(doc_id, source): shard} of the draw over plain lists; ids are distinct."""
    rows = [tuple(r) for r in docs.select("doc_id", "source", F.xxhash64(F.lit(M.SEED), *docs.columns)).collect()]
    count = Counter(s for _, s, _ in rows)
    names = sorted(count, key=lambda s: (s is None, s or ""))
    blocks = {s: max(1, round(count[s] / kw["block_rows"])) for s in names}
    take = M.quotas(blocks, {s: count[s] ** M.ALPHA for s in names}, kw.get("share", M.SHARE))
    kept = sum(take[s] * count[s] / blocks[s] for s in names)
    shards = max(1, -(-round(kept) // kw["shard_rows"]))
    out = {}
    for k, s in enumerate(names):
        own = sorted((r for r in rows if r[1] == s), key=lambda r: r[2] % 2**64)
        for shard in range(shards):
            first, n = M.leaf(np.array([take[x] for x in names]), shards, shard, M.SEED)
            for b in M.permuted(np.arange(first[k], first[k] + n[k]), blocks[s], M.SEED * 1_000_003 + k):
                out |= {r[:2]: shard for i, r in enumerate(own) if i * blocks[s] // len(own) == b}
    return out


@pytest.mark.parametrize("share", [None, 0.6, 1.0])
def test_equals_plain_draw(spark, share):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(5000)]
    kw = {"block_rows": 8, "shard_rows": 300, "share": share}
    docs = frame(spark, rows)
    found = M.mix_sources(docs, placed=True, **kw).collect()
    assert {(r.doc_id, r.source): r.shard for r in found} == reference(docs, **kw)
    by = Counter(r.shard for r in found)
    assert all(sorted(r.slot for r in found if r.shard == k) == list(range(n)) for k, n in by.items())
    assert len({r.doc_id for r in found}) == len(found)


def test_more_blocks_than_numpy_draws():
    rng = np.random.default_rng(4)
    for quota in ([7, 0, 3, 10**12, 10**10], [10**9, 1], [3 * 10**9] * 40, [0, 10**11]):
        quota = np.array(quota)
        for size in (0, 1, int(quota.sum()) // 3, int(quota.sum()) - 1, int(quota.sum())):
            got = M.draw(quota, size, rng)
            assert got.sum() == size and (got >= 0).all() and (got <= quota).all()
    small = np.array([[*M.draw(np.array([30, 70, 100]), 60, rng, most=50)] for _ in range(4000)])  # in units of 4
    assert small.sum(1).tolist() == [60] * 4000 and small.mean(0) == pytest.approx([9, 21, 30], abs=4)
    ends = np.zeros(2, int)
    for shard in range(3):
        first, n = M.leaf(np.array([4 * 10**9, 10**9]), 3, shard, 3)
        assert (first == ends).all()
        ends = first + n
    assert ends.tolist() == [4 * 10**9, 10**9]


def test_draw_does_not_depend_on_the_tasks(spark):
    """Ids that repeat or are null, texts that repeat, in another order and other partitions: the same rows."""
    rows = [(None if i % 3 == 0 else i % 50, f"text {i % 400}", "a" if i % 3 else "b") for i in range(1500)]
    df = lambda rows: spark.createDataFrame(rows, "doc_id int, text string, source string")
    one = sorted(map(repr, M.mix_sources(df(rows), {"a": 1.0, "b": 0.2}, block_rows=4, shard_rows=100, placed=True, share=0.5).drop("slot").collect()))
    two = sorted(map(repr, M.mix_sources(df(rows[::-1]).repartition(7), {"a": 1.0, "b": 0.2}, block_rows=4, shard_rows=100, placed=True, share=0.5).drop("slot").collect()))
    assert one == two and 600 < len(one) < 900
    named = df(rows).withColumns({"doc_id": F.lit("id"), "m": F.create_map(F.lit("k"), "text")})
    assert M.mix_sources(named, placed=True).columns == ["doc_id", "text", "source", "m", "shard", "slot"]


def test_weights_are_met(spark):
    rows = [(i, "abc"[min(i % 10, 2)]) for i in range(20_000)]
    got = Counter(r.source for r in M.mix_sources(frame(spark, rows), {"a": 0.5, "b": 0.25, "c": 0.25}, block_rows=10, share=None).collect())
    assert got["a"] == 2000 and got["b"] == got["c"] == 1000


def test_a_scarce_source_does_not_bind_the_others():
    rows = {f"s{i:02}": 770_000 for i in range(20)}
    blocks = lambda x: {s: max(1, round(n / 32)) for s, n in x.items()}
    for more in ({}, {"tiny": 100}, {None: 1}, {"tiny": 100, None: 1}):
        every = rows | more
        take = M.quotas(blocks(every), {s: n**M.ALPHA for s, n in every.items()}, 1.0)
        assert all(take[s] == blocks(more)[s] for s in more) and all(0.999 < take[s] / blocks(rows)[s] <= 1 for s in rows)
    assert M.quotas({"a": 10, "b": 100, "c": 90}, {"a": 1, "b": 1, "c": 2}, 0.5) == {"a": 10, "b": 25, "c": 50}
    assert M.quotas({"a": 1, "b": 1, None: 1}, {"a": 1, "b": 3, None: 4}, 1.0) == {"a": 1, "b": 1, None: 1}


def test_query_keeps_the_corpus_beside_a_scarce_source(spark, tmp_path):
    from tidewater.llm.queries import QUERIES

    rows = [(i, f"s{i % 4}") for i in range(4 * 640)] + [(9000 + i, "tiny") for i in range(20)] + [(9999, None)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(r.source for r in QUERIES["op9_mix_sources"](spark, str(tmp_path)).select("source").collect())
    assert got["tiny"] == 20 and got[None] == 1 and all(got[f"s{k}"] > 0.9 * 640 for k in range(4))


def test_edge_cases(spark):
    rows = [(None, "a")] * 5 + [(1, "a"), (1, "a"), (2, None), (3, None), (4, "")]
    docs = frame(spark, rows)
    out = M.mix_sources(docs, block_rows=1, alpha=1.0, share=None)
    assert out.columns == docs.columns and out.count() == 10
    assert M.mix_sources(docs, {None: 1.0}).count() == 2
    assert M.mix_sources(docs, {"missing": 1.0}).count() == 0
    empty = docs.limit(0)
    assert M.mix_sources(empty).count() == 0
    again = [tuple(r) for r in M.mix_sources(docs, block_rows=1, alpha=1.0, share=None).collect()]
    assert again == [tuple(r) for r in out.collect()]
