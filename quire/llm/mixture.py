"""A mix of sources with target shares of all tokens.

Method: each source's documents are packed, in a pseudorandom order, into blocks of a
fixed number of tokens. The slots of the mix are dealt to output shards; for
each shard the counts of the sources are drawn from the multinomial distribution
conditioned on the totals, so that the whole mix has the wanted shares to
within one block. A source's slots run through pseudorandom permutations of its
block numbers, one permutation for each pass, and blocks join the slots by number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import tokens
from quire.session import fetch, materialize, spread, task_count

#: Tokens of a block and slots of an output shard.
BLOCK, SHARD_SLOTS = 512, 1024
#: Shards whose counts one row of the plan draws: the driver deals the mix to groups of shards, tasks deal a group to its shards.
GROUP = 4096
#: Parts into which each source's documents are hashed for the running totals of their tokens. Only keys and sizes are sorted there, tens of bytes for a document.
PARTS = 4096
ROUNDS = 4


def clean_source(c: Column) -> Column:
    """A source name in lower case, trimmed, with hyphens and blanks as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


@dataclass
class Plan:
    """For each source: wanted tokens, tokens it can give, slots it gets."""

    source: list[str]
    share: list[float]
    repeats: list[int]
    own: list[int]
    blocks: list[int]
    slots: list[int]


def plan(targets: list[tuple[str, float, int]], own: dict[str, int], block: int = BLOCK, total: int | None = None) -> Plan:
    """Slots of each source (name, share, most repeats) whose documents hold `own` tokens.

    The mix is as large as the documents with a target are, or `total` tokens. A
    source gives at most its repeats; what it lacks, others give in
    proportion to their shares as far as they can, so the mix keeps its size where that is possible.
    """
    names = sorted(targets)
    have = np.array([float(own.get(n, 0)) for n, _, _ in names])
    most = have * np.array([max(0, r) for _, _, r in names], dtype=float)
    share = np.array([max(0.0, s) for _, s, _ in names])
    size = float(have.sum() if total is None else total)
    give = np.zeros(len(names))
    open_ = (most > 0) & (share > 0)
    left = size
    while left > 1e-9 and open_.any():
        part = left * share * open_ / (share * open_).sum()
        step = np.minimum(part, most - give)
        give += step
        left -= step.sum()
        full = open_ & (give >= most - 1e-9)
        if not full.any():
            break
        open_ &= ~full
    blocks = [-(-int(h) // block) for h in have]
    # A source's last block may be short: slots count blocks, and never more than its repeats allow.
    slots = [min(int(round(g / (h / b))) if b else 0, b * max(0, r)) for g, h, b, (_, _, r) in zip(give, have, blocks, names)]
    return Plan([n for n, _, _ in names], [s for _, s, _ in names], [r for _, _, r in names], [int(h) for h in have], blocks, slots)


def deal(slots: list[int], shard_slots: int, seed: int) -> np.ndarray:
    """Counts of the sources in each shard: multinomial draws conditioned on the totals (rows sum to the shard's size)."""
    rng = np.random.default_rng(seed)
    left = np.array(slots, dtype=np.int64)
    out = []
    while left.sum():
        n = min(shard_slots, int(left.sum()))
        drawn = rng.multivariate_hypergeometric(left, n, method="marginals")
        out.append(drawn)
        left -= drawn
    return np.array(out, dtype=np.int64).reshape(-1, len(slots))


def _mix(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (splitmix) of position and key."""
    z = (x.astype(np.uint64) + key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key, by a Feistel network walked until the value is in range."""
    size = size.astype(np.int64)
    bits = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2)
    mask = (np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1)
    half = bits.astype(np.uint64)
    out = index.astype(np.int64).copy()
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            v, m, h, k = out[todo].astype(np.uint64), mask[todo], half[todo], key[todo]
            left, right = v >> h, v & m
            for r in range(ROUNDS):
                left, right = right, left ^ (_mix(right, k.astype(np.uint64) * np.uint64(ROUNDS) + np.uint64(r)) & m)
            out[todo] = ((left << h) | right).astype(np.int64)
            todo = todo[out[todo] >= size[todo]]
    return out


def mixture(
    docs: DataFrame,
    targets: DataFrame,
    vocabulary: str | None = None,
    block: int = BLOCK,
    shard_slots: int = SHARD_SLOTS,
    total: int | None = None,
    seed: int = 11,
) -> tuple[DataFrame, DataFrame]:
    """(mix, shares).

    mix: shard, slot, piece_no, source, pass_no, doc_id, from_token, ids - the
    documents' tokens in the order of the mix; a document of several blocks
    stands in several slots, and none of its tokens is used more often than its source allows.
    shares: source, target_share, max_repeats, own_tokens, mixed_tokens,
    reached_share, repeats.

    Sources are compared in a clean form; documents of sources without a target, null
    ones included, and documents without tokens take no part. A source without
    documents has the share 0. An empty table gives no mix and shares of 0.
    """
    spark = docs.sparkSession
    wanted = targets.groupBy(clean_source(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter("source IS NOT NULL")
    # The table of targets is kept by hand, one row a source.
    rows = [(r["source"], r["target_share"] or 0.0, r["max_repeats"] or 0) for r in wanted.collect()]
    used = docs.select("doc_id", clean_source(F.col("source")).alias("source"), "text").join(F.broadcast(wanted.select("source")), "source")
    encoded = tokens.encode(spread(used.select(F.struct("doc_id", "source").alias("k"), "text")), "k", "text", vocabulary)
    encoded = materialize(encoded.select("k.doc_id", "k.source", "ids", F.size("ids").cast("bigint").alias("n")).filter("n > 0").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))))
    # What is checkpointed keeps its place, so the number of a row stays the same.
    encoded = encoded.withColumn("row", F.monotonically_increasing_id())
    sums = fetch(encoded.groupBy("source", "part").agg(F.sum("n").alias("n")))
    own = sums.groupby("source").n.sum().to_dict() if len(sums) else {}
    p = plan(rows, {k: int(v) for k, v in own.items()}, block, total)

    # Where each hashed part of a source begins in the source's row of tokens: at most PARTS rows a source.
    if len(sums):
        sums = sums.sort_values(["source", "part"])
        sums["base"] = sums.groupby("source").n.cumsum() - sums.n
    base = spark.createDataFrame([(r.source, int(r.part), int(r.base)) for r in sums.itertuples()] if len(sums) else [], "source string, part bigint, base bigint")
    # Running totals within a part: parts of a source of a third of all rows are each a small part of it.
    within = Window.partitionBy("source", "part").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = encoded.select("row", "source", "part", "doc_id", "n").withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(base), ["source", "part"])
    placed = encoded.select("row", "source", "doc_id", "ids", "n").join(placed.select("row", (F.col("base") + F.col("before")).alias("at")), "row")
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n") - 1) / block)
    pieces = placed.select("source", "doc_id", "ids", "n", "at", F.explode(F.sequence(first, last)).alias("block_no"))
    start = F.greatest(F.col("block_no") * block - F.col("at"), F.lit(0)).cast("int")
    stop = F.least((F.col("block_no") + 1) * block - F.col("at"), F.col("n")).cast("int")
    pieces = pieces.select("source", "block_no", "doc_id", start.alias("from_token"), F.slice("ids", start + 1, stop - start).alias("ids"), (F.col("at") + start - F.col("block_no") * block).alias("offset"))

    # Groups of shards get their counts here, one row each; shards of a group get theirs in its task.
    counts = deal(p.slots, shard_slots * GROUP, seed)
    offsets = np.cumsum(counts, axis=0) - counts
    groups = spark.createDataFrame([(g, [int(x) for x in counts[g]], [int(x) for x in offsets[g]]) for g in range(len(counts))], "group int, counts array<bigint>, first array<bigint>")
    names, blocks_of = list(p.source), list(p.blocks)

    def shards_of(batches):
        for pdf in batches:
            for g, n, begin in zip(pdf["group"], pdf["counts"], pdf["first"]):
                own = deal([int(x) for x in n], shard_slots, seed * 1_000_003 + int(g) + 1)
                start = np.asarray(begin) + np.cumsum(own, axis=0) - own
                at, k = np.nonzero(own)
                yield pd.DataFrame({"shard": (at + int(g) * GROUP).astype("int32"), "source": [names[x] for x in k], "k": k.astype("int32"), "first": start[at, k], "count": own[at, k], "blocks": [blocks_of[x] for x in k]})

    shards = groups.repartition(max(1, min(len(counts), task_count(spark))), "group").mapInPandas(shards_of, "shard int, source string, k int, first bigint, count bigint, blocks bigint")

    def slots(batches):
        for pdf in batches:
            for shard, g in pdf.groupby("shard"):
                n = g["count"].to_numpy()
                order = np.concatenate([np.arange(f, f + c) for f, c in zip(g["first"], n)])
                k, blocks = np.repeat(g["k"].to_numpy(), n), np.repeat(g["blocks"].to_numpy(), n)
                passes = order // blocks
                at = permute(order % blocks, blocks, (k.astype(np.int64) * 1_000_003 + passes) ^ seed)
                # The order of the slots within a shard is a permutation as well.
                place = permute(np.arange(len(order)), np.full(len(order), len(order)), np.full(len(order), int(shard) + 7_919 * (seed + 1)))
                yield pd.DataFrame({"shard": shard, "slot": place.astype("int32"), "source": np.repeat(g["source"].to_numpy(), n), "pass_no": (passes + 1).astype("int32"), "block_no": at})

    laid = shards.repartition("shard").mapInPandas(lambda b: slots(_whole(b)), "shard int, slot int, source string, pass_no int, block_no bigint")
    joined = laid.join(pieces, ["source", "block_no"])
    mix = joined.select("shard", "slot", F.col("offset").cast("int").alias("piece_no"), "source", "pass_no", "doc_id", "from_token", "ids")
    goal = spark.createDataFrame([(s, float(w), int(r), o) for s, w, r, o in zip(p.source, p.share, p.repeats, p.own)], "source string, target_share double, max_repeats int, own_tokens bigint")
    mixed = mix.groupBy("source").agg(F.sum(F.size("ids")).cast("bigint").alias("mixed_tokens"))
    shares = goal.join(F.broadcast(mixed), "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0).cast("bigint")))
    # A window over one row for each source of the small table of targets.
    everything = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))
    shares = shares.select(
        "*",
        F.when(everything > 0, F.col("mixed_tokens") / everything).otherwise(0.0).alias("reached_share"),
        F.when(F.col("own_tokens") > 0, F.col("mixed_tokens") / F.col("own_tokens")).otherwise(0.0).alias("repeats"),
    )
    return mix, shares


def _whole(batches):
    """A partition as one frame: it holds a row for each source of its shards."""
    frames = list(batches)
    if frames:
        yield pd.concat(frames, ignore_index=True)
