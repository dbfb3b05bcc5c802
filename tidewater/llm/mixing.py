"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The rows of a source, in the order of a hash of their columns, are cut into blocks of
equal size (to one row). Target weights and a total give each source an exact quota
of blocks: the total is a share of the corpus, of which a source too scarce for its
part gives all it has, or what the scarcest source allows at these weights. The
quotas belong to the root of a binary tree over the output shards; at each node the left half's share of every source is one draw from
the multivariate hypergeometric distribution, seeded by the node, so any task can
walk from the root to its shard and all agree. A shard draws its quota as the next
blocks of a keyed permutation of the source's blocks: draws are disjoint, without
replacement, and need no coordination. Rows are shuffled within the shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import common as C

BLOCK_ROWS = 32
SHARD_ROWS = 4096
ALPHA = 0.5
SEED = 20
#: Share of the corpus that is shared out. None: the scarcest source allows the total.
SHARE = 1.0
#: More blocks than this are drawn in units of several, since numpy draws from fewer than 10**9.
DRAWN = 5 * 10**8


def quotas(blocks: dict, weights: dict, share: float | None = None) -> dict:
    """Blocks to take of each source: a total shared out at these weights, by largest remainders (ties by source name).

    The total is as many as the scarcest source allows; with share, this share of all blocks of the weighted sources. Then a source
    that has fewer than its part gives all of them, and what it lacks isn't taken from others, so it doesn't bind their quotas.
    """
    names = sorted((s for s in blocks if weights.get(s, 0) > 0 and blocks[s]), key=lambda s: (s is None, s or ""))
    total = sum(weights[s] for s in names)
    if not names:
        return {}
    size = int((min(blocks[s] * total / weights[s] for s in names) if share is None else share * sum(blocks[s] for s in names)) + 1e-9)
    exact = {s: size * weights[s] / total for s in names}
    out = {s: int(exact[s] + 1e-9) for s in names}
    left = size - sum(out.values())
    out = {s: min(out[s], blocks[s]) for s in names}
    open_ = names if share is None else [s for s in names if out[s] < blocks[s]]
    for s in sorted(open_, key=lambda s: (out[s] - exact[s], s is None, s or ""))[:left]:
        out[s] += out[s] < blocks[s]
    return out


def draw(quota: np.ndarray, size: int, rng: np.random.Generator, most: int = DRAWN) -> np.ndarray:
    """How many of size blocks, drawn from all of quota, are of each source. Beyond most blocks, as many as fit are drawn in equal units of several, the rest one by one; the sums stay exact."""
    total = int(quota.sum())
    if total <= most:
        return rng.multivariate_hypergeometric(quota, size, method="marginals")
    unit = -(-total // most)
    coarse = np.maximum(quota // unit - 1, 0)
    units = min(size // unit, int(coarse.sum()))
    # a unit of each source is broken up, so that what units can't make up can always be drawn
    return unit * rng.multivariate_hypergeometric(coarse, units, method="marginals") + draw(quota - unit * coarse, size - unit * units, rng, max(most, 2 * unit * len(quota)))


def split(quota: np.ndarray, lo: int, hi: int, seed: int) -> tuple[int, np.ndarray]:
    """The middle of the shards [lo, hi) and the left half's quotas."""
    mid, total = (lo + hi) // 2, int(quota.sum())
    left = total * (mid - lo) // (hi - lo)
    return mid, draw(quota, left, np.random.default_rng([seed, lo, hi]))


def leaf(quota: np.ndarray, shards: int, shard: int, seed: int, memo: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of every source in this shard: the walk from the root."""
    lo, hi, offset = 0, shards, np.zeros_like(quota)
    while hi - lo > 1:
        if memo is None or (lo, hi) not in memo:
            found = split(quota, lo, hi, seed)
            if memo is not None:
                memo[lo, hi] = found
        else:
            found = memo[lo, hi]
        mid, left = found
        if shard < mid:
            hi, quota = mid, left
        else:
            lo, offset, quota = mid, offset + left, quota - left
    return offset, quota


def permuted(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """Places of a keyed permutation of range(n): a Feistel network on the next even power of two, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, keys = np.uint64((1 << half) - 1), C.mix(np.arange(1, 7, dtype=np.uint64) + np.uint64(key % (1 << 63)) * np.uint64(8))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (C.mix(right ^ k) & mask)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        x = once(at.astype(np.uint64))
        while (out := x >= np.uint64(n)).any():
            x[out] = once(x[out])
    return x.astype(np.int64)


def plan(spark, rows: dict, weights: dict | None = None, alpha: float = ALPHA, block_rows: int = BLOCK_ROWS, shard_rows: int = SHARD_ROWS, seed: int = SEED, share: float | None = SHARE) -> tuple[DataFrame, dict, int]:
    """((source_at, block, shard), blocks by source, number of shards). source_at: the source's place in sorted order.

    rows: documents by source. The tree is walked where the shards are, by tasks over the shard numbers.
    """
    names = sorted(rows, key=lambda s: (s is None, s or ""))
    blocks = {s: max(1, round(rows[s] / block_rows)) for s in names}
    weights = {s: rows[s] ** alpha for s in names} if weights is None else weights
    take = quotas(blocks, weights, share)
    quota = np.array([take.get(s, 0) for s in names], np.int64)
    kept = sum(q * rows[s] / blocks[s] for s, q in zip(names, quota.tolist()))
    shards = max(1, -(-round(kept) // shard_rows))
    counts = [blocks[s] for s in names]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for batch in batches:
            for shard in batch["id"].tolist():
                first, n = leaf(quota, shards, shard, seed, memo)
                for s in np.flatnonzero(n).tolist():
                    at = permuted(np.arange(first[s], first[s] + n[s]), counts[s], seed * 1_000_003 + s)
                    yield pd.DataFrame({"source_at": np.full(n[s], s, np.int32), "block": at, "shard": np.full(n[s], shard, np.int64)})

    out = spark.range(0, shards, 1, max(1, min(-(-shards // 64), 20_000))).mapInPandas(walk, "source_at int, block bigint, shard bigint")
    return out, blocks, shards


def row_hash(docs: DataFrame, seed: int):
    """64 bits of all columns that can be hashed, so that rows of one id, or of none, spread as well."""
    return F.xxhash64(F.lit(seed), *(F.col(f"`{f.name}`") for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))))


def mix_sources(docs: DataFrame, weights: dict | None = None, alpha: float = ALPHA, block_rows: int = BLOCK_ROWS, shard_rows: int = SHARD_ROWS, seed: int = SEED, source: str = "source", placed: bool = False, share: float | None = SHARE) -> DataFrame:
    """The drawn rows of docs, shard by shard in shuffled order; with placed also shard and slot (the place in the shard), in place of columns of these names.

    weights: target weight by source; without them a source weighs its rows to the power alpha. Sources that have no weight are
    left out. share: as in quotas; with None the weights are met exactly and one scarce source makes the whole draw small. A null source is a source of its own,
    under the key None. Rows are told apart by a hash of all their columns, maps excepted; which of them are drawn depends on
    nothing else, so a task that runs again draws the same. Repeated rows are separate rows; they hash alike, so a block holds
    them together, and where some of them are drawn it doesn't matter which. Ids play no part of their own: they may be null, repeat, and be of any type.
    An empty table stays empty. Columns of other names pass through. The counts by source come to the driver: a few numbers a source.
    """
    spark = docs.sparkSession
    columns = [F.col(f"`{x}`") for x in docs.columns if not placed or x.lower() not in ("shard", "slot")]
    name = F.col(f"`{source}`").cast("string")
    key = F.when(name.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), name))
    rows = {r[0]: r[1] for r in docs.groupBy(name.alias("s")).agg(F.count("*")).collect()}
    if not rows:
        return docs.select(*columns, F.lit(0).cast("bigint").alias("shard"), F.lit(0).alias("slot")) if placed else docs
    drawn, blocks, _ = plan(spark, rows, weights, alpha, block_rows, shard_rows, seed, share)
    names = sorted(rows, key=lambda s: (s is None, s or ""))
    facts = spark.createDataFrame([("0" if s is None else "1" + s, i, rows[s], blocks[s]) for i, s in enumerate(names)], "s string, source_at int, n bigint, blocks bigint")
    bits = max(1, (sum(rows.values()) // 2048).bit_length())
    c = {x: C.free_name(docs, f"tw_{x}") for x in ("s", "h", "b", "at", "block", "shard", "order")}
    keyed = docs.withColumns({c["s"]: key, c["h"]: row_hash(docs, seed)}).withColumn(c["b"], F.shiftrightunsigned(c["h"], 64 - bits))
    # a row of small numbers for every bucket of about 2,048 rows: where its rows begin in the source, and the shards of its blocks.
    # The sums run over groups of buckets first, then within each group, so a source's buckets are never in one task.
    counts = keyed.groupBy(F.col(c["s"]).alias("s"), F.col(c["b"]).alias("b")).agg(F.count("*").alias("rows")).withColumn("g", F.shiftrightunsigned("b", bits // 2))
    groups = counts.groupBy("s", "g").agg(F.sum("rows").alias("all"))
    base = groups.select("s", "g", (F.sum("all").over(Window.partitionBy("s").orderBy("g")) - F.col("all")).alias("base"))
    before = F.col("base") + F.sum("rows").over(Window.partitionBy("s", "g").orderBy("b")) - F.col("rows")
    spans = counts.join(base, ["s", "g"]).withColumn("before", before).join(facts, "s").withColumn("first", F.expr("before * blocks div n"))
    each = spans.withColumn("block", F.explode(F.expr("sequence(first, (before + rows - 1) * blocks div n)"))).join(drawn, ["source_at", "block"], "left")
    lookup = each.groupBy("s", "b", "before", "n", "blocks", "first").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "shard"))), lambda x: x["shard"]).alias("shards"))
    lookup = lookup.select(F.struct("before", "n", "blocks", "first", "shards").alias(c["block"]), F.col("s").alias(c["s"]), F.col("b").alias(c["b"]))
    inside = F.row_number().over(Window.partitionBy(c["s"], c["b"]).orderBy(c["h"])) - 1
    found = keyed.withColumn(c["at"], inside).join(lookup.hint("shuffle_hash"), [c["s"], c["b"]])
    found = found.withColumn(c["at"], F.col(c["at"]) + F.col(c["block"])["before"])
    found = found.withColumn(c["shard"], F.expr(f"get(`{c['block']}`.shards, cast(`{c['at']}` * `{c['block']}`.blocks div `{c['block']}`.n - `{c['block']}`.first as int))"))
    found = found.where(F.col(c["shard"]).isNotNull()).withColumn(c["order"], F.xxhash64(F.lit(seed + 1), c["s"], c["at"]))
    local = [F.col(c["order"]), F.col(c["s"]), F.col(c["at"])]
    if placed:
        slot = F.row_number().over(Window.partitionBy(c["shard"]).orderBy(*local)) - 1
        return found.withColumn(c["at"], slot).select(*columns, F.col(c["shard"]).alias("shard"), F.col(c["at"]).cast("int").alias("slot"))
    return found.repartition(c["shard"]).sortWithinPartitions(c["shard"], *local).select(*columns)
