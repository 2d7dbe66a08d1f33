"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt by hash to blocks of about `BLOCK_WORDS` words. A source's target is met by whole passes over
its blocks and one partial pass in permuted order; the last block of that pass is cut by document hash, so that the words
taken miss the target by no more than about half a document. The quotas, counted in block draws, are then partitioned among
the output shards by a binary tree: at each node the draws of all sources are split between the halves by one multivariate
hypergeometric draw, so that the shards' quotas add up exactly. A shard takes the next blocks of each source's permutation,
which makes the draws disjoint, and shuffles them locally.

Scale: sources (their names and sizes) go through the driver, nothing else does. Blocks, draws and shard quotas are tables; the
tree is drawn on the driver down to `DRIVER_NODES` nodes and within tasks below. A source of a third of all rows is cut into as
many blocks as its words ask for, so no key holds it. Texts are neither shuffled nor read again after counting their words,
except by `mixed`, which must move them to their shards.

Defined results: null text has size 0; a null source is a source of its own, ordered last; rows with equal doc_id and source
share a hash, and are taken together; documents of size 0 are taken as often as their block. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gleanery.llm.staging import hash60, n_words, staged

BLOCK_WORDS = 1 << 20
LEAST_BLOCKS = 64
SHARD_WORDS = 1 << 24
LEAST_SHARDS = 8
DRIVER_NODES = 256
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
SEED = 20


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, limit: int = LIMIT) -> list[float]:
    """The level that fills `share` of all sizes by weight, no source above `limit` times its size.

    The excess of capped sources is reshared by weight among the others until none is above its cap.
    """
    total, caps = share * sum(sizes), [limit * s for s in sizes]
    capped: set[int] = set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in capped]
        if not rest:
            return [float(c) for c in caps]
        level = (total - sum(caps[i] for i in capped)) / sum(weights[i] for i in rest)
        above = {i for i in rest if level * weights[i] > caps[i]}
        if not above:
            return [float(caps[i]) if i in capped else level * weights[i] for i in range(len(sizes))]
        capped |= above


@dataclass
class Plan:
    """sources: source_key, number, source_size, target, passes, rest, n_blocks; draws: number, block, draws."""

    sources: DataFrame
    draws: DataFrame
    shards: int


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("-"))


def document_hash(doc_id: Column, source: Column, seed: int = SEED) -> Column:
    return hash60(f"doc{seed}", doc_id, source)


def split_quota(counts: np.ndarray, lo: int, hi: int, shards: int, seed: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """One step of the tree: the quotas of the shards lo..hi-1 divided between the two halves."""
    total = int(counts.sum())
    middle = (lo + hi) // 2
    left = total * (middle - lo) // (hi - lo)
    drawn = np.random.default_rng([seed, lo, hi, shards]).multivariate_hypergeometric(counts, left, method="marginals")
    yield lo, middle, drawn
    yield middle, hi, counts - drawn


def _leaves(node: tuple[int, int, np.ndarray], shards: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    stack = [node]
    while stack:
        lo, hi, counts = stack.pop()
        if hi - lo == 1:
            yield lo, counts
        else:
            stack.extend(reversed(list(split_quota(counts, lo, hi, shards, seed))))


def shard_quotas(spark, quotas: Sequence[int], shards: int, seed: int = SEED) -> DataFrame:
    """number, shard, n: how many block draws of a source a shard takes. Over the shards they add up to the quotas."""
    nodes = [(0, shards, np.array(quotas, np.int64))]
    while len(nodes) < DRIVER_NODES and any(hi - lo > 1 for lo, hi, _ in nodes):
        nodes = [
            part
            for lo, hi, counts in nodes
            for part in (split_quota(counts, lo, hi, shards, seed) if hi - lo > 1 else [(lo, hi, counts)])
        ]
    rows = [(lo, hi, [int(c) for c in counts]) for lo, hi, counts in nodes]

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for node in frame.itertuples(index=False):
                for shard, counts in _leaves((node.lo, node.hi, np.asarray(node.counts, np.int64)), shards, seed):
                    some = np.flatnonzero(counts)
                    yield pd.DataFrame({"number": some, "shard": np.int64(shard), "n": counts[some]})

    frontier = spark.createDataFrame(rows, "lo long, hi long, counts array<long>")
    return frontier.mapInPandas(expand, "number long, shard long, n long")


def plan_mix(
    sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: int = SEED
) -> Plan:
    """From doc_id, source, size (and any order of rows) to the draws of every block."""
    spark = sized.sparkSession
    sized = sized.select("doc_id", "source", "size", source_key(F.col("source")).alias("source_key"))
    totals = sized.groupBy("source", "source_key").agg(F.sum("size").alias("source_size")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["source_size"]) for r in totals]
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    goals = targets(sizes, weight, share, limit)
    rows = []
    for i, (r, size, goal) in enumerate(zip(totals, sizes, goals, strict=True)):
        passes = int(goal // size) if size else 0
        n_blocks = max(LEAST_BLOCKS, -(-size // BLOCK_WORDS))
        rows.append((r["source_key"], i, size, goal, passes, goal - passes * size, n_blocks))
    schema = "source_key string, number long, source_size long, target double, passes int, rest double, n_blocks long"
    sources = spark.createDataFrame(rows, schema)

    dealt = sized.join(F.broadcast(sources), "source_key").select(
        "number",
        "size",
        document_hash(F.col("doc_id"), F.col("source"), seed).alias("h"),
        "n_blocks",
    )
    dealt = dealt.withColumn("block", F.pmod("h", "n_blocks"))
    blocks = staged(dealt.groupBy("number", "block").agg(F.sum("size").alias("words")), "blocks")
    # One row for each block and pass, in the order of the pass.
    passes = blocks.join(F.broadcast(sources.select("number", "passes", "rest")), "number").select(
        "*", F.explode(F.sequence(F.lit(0), "passes")).alias("pass")
    )
    order = Window.partitionBy("number", "pass").orderBy("place", "block")
    passes = passes.withColumn("place", hash60(f"block{seed}", F.col("pass"), F.col("number"), F.col("block")))
    passes = passes.withColumn("rank", F.row_number().over(order)).withColumn(
        "upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    whole = (F.col("pass") < F.col("passes")) | (F.col("upto") <= F.col("rest"))
    used = passes.where(whole | (F.col("upto") - F.col("words") < F.col("rest"))).withColumn("is_whole", whole)
    used = staged(used, "passes")
    # The one block of a source that is cut: its documents in hash order, up to the nearest to the target.
    cut = used.where("not is_whole").select("number", "block", (F.col("upto") - F.col("words")).alias("base"), "rest")
    inner = dealt.join(cut, ["number", "block"])
    upto = F.sum("size").over(Window.partitionBy("number", "block").orderBy("h"))
    taken = inner.withColumn("upto", upto).where(F.col("base") + F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    cuts = taken.groupBy("number", "block").agg(F.max("h").alias("cut"))
    used = used.join(cuts, ["number", "block"], "left").withColumn(
        "cut", F.when(F.col("is_whole"), F.lit((1 << 60) - 1)).otherwise(F.coalesce("cut", F.lit(-1)))
    )

    # Each source's draws are numbered pass by pass; the shards take them in turn.
    counted = {r["number"]: r["n"] for r in used.groupBy("number").agg(F.count(F.lit(1)).alias("n")).collect()}
    quotas = [int(counted.get(i, 0)) for i in range(len(rows))]
    shards = max(LEAST_SHARDS, -(-int(share * sum(sizes)) // SHARD_WORDS))
    numbered = used.withColumn(
        "draw", F.row_number().over(Window.partitionBy("number").orderBy("pass", "rank")).cast("long")
    )
    parts = shard_quotas(spark, quotas, shards, seed)
    before = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    turns = parts.select(
        "number", "shard", F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("n"))).alias("draw")
    )
    placed = numbered.join(turns, ["number", "draw"])
    draws = placed.groupBy("number", "block").agg(
        F.sort_array(F.collect_list(F.struct("pass", "shard", "cut"))).alias("draws")
    )
    return Plan(sources, staged(draws, "draws"), shards)


def with_draws(docs: DataFrame, plan: Plan, seed: int = SEED) -> DataFrame:
    """doc_id, source and what else docs has, with its source's size and target and the document's own draws."""
    dealt = docs.withColumn("source_key", source_key(F.col("source"))).join(F.broadcast(plan.sources), "source_key")
    dealt = dealt.withColumn("h", document_hash(F.col("doc_id"), F.col("source"), seed))
    dealt = dealt.withColumn("block", F.pmod("h", "n_blocks"))
    found = dealt.join(plan.draws, ["number", "block"], "left")
    own = F.filter(F.coalesce("draws", F.array().cast(found.schema["draws"].dataType)), lambda d: d["cut"] >= F.col("h"))
    return found.withColumn("draws", own)


def sizes(docs: DataFrame) -> DataFrame:
    return staged(docs.select("doc_id", "source", n_words(F.col("text").cast("string")).alias("size")), "sizes")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes of it."""
    sized = sizes(docs)
    plan = plan_mix(sized, **options)
    found = with_draws(sized, plan)
    return found.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: documents as often as they are drawn, by shard and shuffled within it; the columns of docs."""
    plan = plan_mix(sizes(docs), **options)
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source")
    found = with_draws(whole, plan).select("row", "h", F.explode("draws").alias("draw"))
    place = hash60("place", F.col("draw.pass"), F.col("h"))
    rows = found.select("row", F.col("draw.shard").alias("shard"), place.alias("place"))
    return rows.repartition("shard").sortWithinPartitions("shard", "place").select("row.*")
